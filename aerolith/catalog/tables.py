"""Sources and sinks: feeds, feature tables, exports."""

from pyspark.sql import functions as F, types as T

from aerolith.catalog import feature_sql as Q
from aerolith.catalog.base import (
    COPIES,
    ID,
    OBS,
    PREDICTIONS,
    SPLIT_FORECAST,
    layout_of,
    observations,
    predictions,
    r,
    rounded,
    rs,
    split_forecast,
    with_,
    with_copies,
)
from aerolith.catalog.rules import band_keys, bands_sql
from aerolith.operators import split as M
from aerolith.plans import chains
from aerolith.schema import AIR, FEED_TARGET, KEYS, RAW, TIME, WEATHER
from aerolith.session import shared_dir
from aerolith.sources import landing, store

START, END = "2024-01-10 05:00:00", "2024-01-20 17:00:00"


def _ts(text):
    return F.expr(f"timestamp_ntz '{text}'")


def _through_feed(df, variables, read_as, decode, batch_days=7, names=None):
    """Write a table as feed responses, read them back and decode them."""
    path = shared_dir(df.sparkSession, "landing")
    landing.to_landing(df, variables, batch_days, names).write.json(path)
    return decode(landing.read_landing(df.sparkSession, path, read_as))


def _decode_weather(spark, sf_dir):
    return _through_feed(observations(spark, sf_dir), WEATHER, WEATHER, landing.decode_weather)


def _decode_air(spark, sf_dir):
    feed = [*AIR[:-1], FEED_TARGET]
    return _through_feed(observations(spark, sf_dir), AIR, feed, landing.decode_air, names={"aqi": FEED_TARGET})


def _decode_forecast(spark, sf_dir):
    _, future = split_forecast(observations(spark, sf_dir))
    return _through_feed(future, WEATHER, WEATHER, landing.decode_weather)


def _spans(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(*KEYS).agg(
        F.to_date(F.min(TIME)).alias("start"), F.to_date(F.max(TIME)).alias("end")
    )


def _feature_upsert(spark, sf_dir):
    """A first load, then a second one that corrects some hours and adds others."""
    rows = with_copies(observations(spark, sf_dir))
    path = shared_dir(spark, "features")
    store.upsert(rows.filter((F.col("ingest_seq") == 0) & (F.hour(TIME) < 20)), path, shards=4)
    store.upsert(rows.filter((F.col("ingest_seq") == 1) | (F.hour(TIME) >= 20)), path, shards=4)
    return store.plain(store.read_table(spark, path))


def _written(spark, sf_dir):
    path = shared_dir(spark, "table")
    store.append(observations(spark, sf_dir), path, shards=4)
    return store.read_table(spark, path)


def _feature_append(spark, sf_dir):
    rows = with_copies(observations(spark, sf_dir))
    path = shared_dir(spark, "appended")
    store.append(rows.filter("ingest_seq = 0"), path, shards=4)
    store.append(rows.filter("ingest_seq = 1"), path, shards=4)
    store.append(rows.filter("ingest_seq = 2"), path, shards=4)
    return store.read_table(spark, path).drop(store.MONTH, store.SHARD)


def _forecast_scan(spark, sf_dir):
    _, future = split_forecast(observations(spark, sf_dir))
    path = shared_dir(spark, "forecast")
    store.append(chains.features_forecast(future, layout=layout_of(spark, sf_dir)), path, shards=4)
    table = store.read_table(spark, path)
    return store.plain(store.range_scan(table, _ts("2024-01-28 06:00:00"), _ts("2024-01-29 12:00:00")))


def _feature_view(spark, sf_dir):
    features, label = store.feature_view(chains.features_full(observations(spark, sf_dir), layout=layout_of(spark, sf_dir)), "aqi_feature_view")
    return features.select(*ID, "pm2_5_lag_1h", "aqi_change_1h").join(label, list(ID))


TRAINING_COLUMNS = (*ID, *RAW)


def _training(spark, sf_dir):
    path = shared_dir(spark, "training")
    store.training_dataset(observations(spark, sf_dir).select(*TRAINING_COLUMNS), path, _ts(START), _ts(END))
    schema = T.StructType(
        [T.StructField("station_id", T.IntegerType()), T.StructField(TIME, T.TimestampNTZType())]
        + [T.StructField(c, T.DoubleType()) for c in RAW]
        + [T.StructField("split", T.StringType())]
    )
    return path, schema


def _training_dataset(spark, sf_dir):
    path, schema = _training(spark, sf_dir)
    return spark.read.schema(schema).option("header", True).csv(path)


def _training_read(spark, sf_dir):
    path, schema = _training(spark, sf_dir)
    return store.read_training(spark, path, schema, M.VALIDATION)


def _csv_export(spark, sf_dir):
    path = shared_dir(spark, "csv")
    store.csv_export(predictions(observations(spark, sf_dir)), path)
    return spark.read.schema("station_id int, timestamp timestamp_ntz, predicted_aqi double").option("header", True).csv(path)


def _prediction_cache(spark, sf_dir):
    path = shared_dir(spark, "predictions")
    pred = predictions(observations(spark, sf_dir))
    run = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    store.write_predictions(store.prediction_records(pred, run), path)
    return store.read_predictions(spark, path)


def _union_batches(spark, sf_dir):
    """Batches of a week that share their boundary day; the later one is higher by 1."""
    obs = observations(spark, sf_dir)
    day = F.to_date(TIME)
    span = obs.agg(F.min(day).alias("start"), F.date_add(F.max(day), 1).alias("end"))
    weeks = landing.backfill_batches(span, 7).orderBy("batch").collect()  # a row per week of the span
    batches = [
        obs.filter(day.between(F.lit(w["batch_start"]), F.lit(w["batch_end"]))).withColumn("aqi", F.col("aqi") + i)
        for i, w in enumerate(weeks)
    ]
    return landing.union_batches(batches)


QUERIES = {
    "decode_weather": lambda s, d: rounded(_decode_weather(s, d)),
    "decode_air": lambda s, d: rounded(_decode_air(s, d)),
    "decode_forecast": lambda s, d: rounded(_decode_forecast(s, d)),
    "backfill_batches": lambda s, d: landing.backfill_batches(_spans(s, d), 7),
    "feature_upsert": lambda s, d: rounded(_feature_upsert(s, d)),
    "feature_append": lambda s, d: rounded(_feature_append(s, d)),
    "range_scan": lambda s, d: rounded(store.plain(store.range_scan(_written(s, d), _ts(START), _ts(END)))),
    "latest_features": lambda s, d: rounded(store.plain(store.latest(_written(s, d), _ts("2024-01-30 10:30:00")))),
    "forecast_scan": lambda s, d: rounded(_forecast_scan(s, d)),
    "feature_view": lambda s, d: rounded(_feature_view(s, d)),
    "training_dataset": lambda s, d: rounded(_training_dataset(s, d)),
    "training_read": lambda s, d: rounded(_training_read(s, d)),
    "full_scan": lambda s, d: rounded(store.plain(_written(s, d).withColumn("_id", F.lit(1)))),
    "csv_export": lambda s, d: rounded(_csv_export(s, d)),
    "prediction_cache": lambda s, d: rounded(_prediction_cache(s, d)),
    "union_batches": lambda s, d: rounded(_union_batches(s, d)),
}

_split = """
ranged_obs as (select * from obs where time between timestamp '{start}' and timestamp '{end}'),
hours as (select time, count(*) as n from ranged_obs group by time),
placed as (select time, coalesce(sum(n) over (order by time rows between unbounded preceding and 1 preceding), 0) as b,
  sum(n) over () as total from hours),
sized as (select time, b, total - cast(floor(total * 0.1) as bigint) as n_rest from placed),
cuts as (select time, case when b >= n_rest then 'test' when b >= n_rest - n_rest // 6 then 'val' else 'train' end as split from sized)
"""


def split_sql(source="obs", start="1900-01-01 00:00:00", end="2999-01-01 00:00:00"):
    """CTEs ending in ``cuts``: the split of each hour."""
    return _split.replace("from obs", f"from {source}").format(start=start, end=end)


_range = f"time between timestamp '{START}' and timestamp '{END}'"
_all = f"station_id, time, {rs(RAW)}"

ORACLES = {
    "decode_weather": f"{with_(OBS)} select station_id, time, {rs(WEATHER)} from obs",
    "decode_air": f"{with_(OBS)} select station_id, time, {rs(AIR)} from obs",
    "decode_forecast": f"{with_(OBS, SPLIT_FORECAST)} select station_id, time, {rs(WEATHER)} from future",
    "backfill_batches": f"""{with_(OBS,
        'spans as (select station_id, cast(min(time) as date) as s, cast(max(time) as date) as e from obs group by 1)',
        'lows as (select station_id, e, unnest(generate_series(s, e - 1, interval 7 day)) as lo from spans where s < e)')}
        select station_id, cast(row_number() over (partition by station_id order by lo) as int) as batch,
        cast(lo as date) as batch_start, cast(least(lo + interval 7 day, e) as date) as batch_end from lows""",
    "feature_upsert": f"""{with_(OBS, COPIES)} select {_all} from copies
        qualify row_number() over (partition by station_id, time order by ingest_seq desc) = 1""",
    "feature_append": f"{with_(OBS, COPIES)} select {_all}, ingest_seq from copies",
    "range_scan": f"{with_(OBS)} select {_all} from obs where {_range}",
    "latest_features": f"""{with_(OBS)} select {_all} from obs
        where time >= timestamp '2024-01-30 10:30:00' - interval 72 hour""",
    "forecast_scan": f"""{with_(OBS, SPLIT_FORECAST, Q.forecast_features_ctes())}
        select station_id, time, {rs(Q.FORECAST_DOUBLES)}, {', '.join(Q.CALENDAR_EXPRS)}, season from forecast_features
        where time between timestamp '2024-01-28 06:00:00' and timestamp '2024-01-29 12:00:00'""",
    "feature_view": f"""{with_(OBS, Q.features_ctes())}
        select station_id, time, {rs(('pm2_5_lag_1h', 'aqi_change_1h', 'aqi'))} from features""",
    "training_dataset": f"""{with_(OBS, split_sql('obs', START, END))} select o.station_id, o.time,
        {', '.join(r('o.' + c, c) for c in RAW)}, split from ranged_obs o join cuts on o.time = cuts.time""",
    "training_read": f"""{with_(OBS, split_sql('obs', START, END))} select o.station_id, o.time,
        {', '.join(r('o.' + c, c) for c in RAW)}, split from ranged_obs o join cuts on o.time = cuts.time
        where split = 'val'""",
    "full_scan": f"{with_(OBS)} select {_all} from obs",
    "csv_export": f"{with_(OBS, PREDICTIONS)} select station_id, timestamp, {r('predicted_aqi')} from pred",
    "prediction_cache": f"""{with_(OBS, PREDICTIONS)} select station_id, timestamp, {r('predicted_aqi')},
        date_trunc('day', timestamp) as generated_at, {bands_sql('predicted_aqi', band_keys(1))} as aqi_category from pred""",
    "union_batches": f"""{with_(OBS, "first as (select min(cast(time as date)) as day from obs)")}
        select station_id, time, {rs([c for c in RAW if c != 'aqi'])},
        {r("aqi + date_diff('day', day, cast(time as date)) // 7", 'aqi')} from obs cross join first""",
}
