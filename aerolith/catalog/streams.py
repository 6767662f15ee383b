"""Streams, run over what is there and compared with batch SQL."""

from pyspark.sql import functions as F

from aerolith.catalog import feature_sql as Q
from aerolith.catalog.base import (
    COPIES,
    OBS,
    PREDICTIONS,
    observations,
    predictions,
    r,
    rounded,
    rs,
    with_,
    with_copies,
)
from aerolith.catalog.rules import alert_sql, band_keys, bands_sql, groups_sql
from aerolith.catalog.statistics import label_sql
from aerolith.schema import RAW, TIME
from aerolith.session import shared_dir
from aerolith.sources import store
from aerolith.streaming import jobs as J


def _run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _through_files(spark, stream, name):
    """Run a stream into a file sink and read the sink."""
    path = shared_dir(spark, name)
    schema = stream.schema
    _run(J.to_files(stream, path, shared_dir(spark, f"{name}-checkpoint")))
    return spark.read.schema(schema).parquet(path)


def _hours(spark, rows):
    """Hourly rows as a stream."""
    folder = shared_dir(spark, "arrivals")
    for part in rows:
        part.select(*[f.name for f in J.HOURLY]).write.mode("append").parquet(folder)
    return J.hourly_stream(spark, folder)


def _first_load(spark, sf_dir):
    return [observations(spark, sf_dir).withColumn("ingest_seq", F.lit(0))]


def _hourly(spark, sf_dir):
    """All hours with events, closed or not."""
    path = shared_dir(spark, "hourly")
    stream = J.hourly(J.event_stream(spark, sf_dir))
    _run(J.for_each(stream, J.upsert_hours(path, 4), shared_dir(spark, "hourly-checkpoint"), "update"))
    return store.plain(store.read_table(spark, path))


def _dedupe(spark, sf_dir):
    path = shared_dir(spark, "latest")
    stream = J.latest_reading(J.event_stream(spark, sf_dir))
    _run(J.for_each(stream, J.upsert_batches(path, 4), shared_dir(spark, "latest-checkpoint"), "update"))
    return store.read_table(spark, path).drop(store.MONTH, store.SHARD)


def _refresh(spark, sf_dir):
    """Hours up to the 20th arrive first, then the rest with corrections."""
    rows = with_copies(observations(spark, sf_dir))
    early = (F.col("ingest_seq") == 0) & (F.dayofmonth(TIME) <= 20)
    folder = shared_dir(spark, "arrivals")
    raw, features, months = (shared_dir(spark, n) for n in ("raw", "features", "months"))
    checkpoint = shared_dir(spark, "refresh-checkpoint")
    cols = [f.name for f in J.HOURLY]
    for part in (rows.filter(early), rows.filter(~early)):
        part.select(*cols).write.mode("append").parquet(folder)
        _run(J.for_each(J.hourly_stream(spark, folder), J.refresh_features(raw, features, months, 4), checkpoint))
    return J.refreshed(spark, features, months)


def _lags(spark, sf_dir):
    return _through_files(spark, J.lag_state(_hours(spark, _first_load(spark, sf_dir))), "lags")


def _errors(spark, sf_dir):
    hours = _hours(spark, _first_load(spark, sf_dir))
    return _through_files(spark, J.error_monitor(hours, predictions(observations(spark, sf_dir))), "errors")


def _alerts(spark, sf_dir):
    out = _through_files(spark, J.alert_stream(_hours(spark, _first_load(spark, sf_dir))), "alerts")
    return out.withColumn("affected_groups", F.array_join("affected_groups", ","))


QUERIES = {
    "stream_hourly": lambda s, d: rounded(_hourly(s, d)),
    "stream_dedupe": lambda s, d: _dedupe(s, d),
    "stream_feature_refresh": lambda s, d: rounded(_refresh(s, d)),
    "stream_lag_state": lambda s, d: rounded(_lags(s, d)),
    "stream_error_monitor": lambda s, d: rounded(_errors(s, d)),
    "stream_alerts": lambda s, d: rounded(_alerts(s, d)),
}

_pct = "abs(predicted_aqi - aqi) / nullif(aqi, 0) * 100"

ORACLES = {
    "stream_hourly": f"{with_(OBS)} select station_id, time, {rs(RAW)} from hourly",
    "stream_dedupe": f"""{with_(OBS)} select station_id, time, max(event_id) as ingest_seq, arg_max(c, event_id) as c,
        arg_max(event_type, event_id) as event_type from ev group by station_id, time""",
    "stream_feature_refresh": f"""{with_(OBS, COPIES, '''corrected as (select * exclude (ingest_seq) from copies
            qualify row_number() over (partition by station_id, time order by ingest_seq desc) = 1)''',
        Q.features_ctes('corrected'))} select {', '.join(Q.FEATURE_OTHERS)}, {rs(Q.FEATURE_DOUBLES)} from features""",
    "stream_lag_state": f"""{with_(OBS, f'lagged as (select station_id, time, {Q.LAG_SQL}, {Q.CHANGE_SQL} from obs)')}
        select station_id, time, {rs(Q.LAG_COLUMNS + Q.CHANGE_COLUMNS)} from lagged""",
    "stream_error_monitor": f"""{with_(OBS, PREDICTIONS,
        '''j as (select o.station_id, o.time, o.aqi, p.timestamp, p.predicted_aqi from obs o join pred p
             on o.station_id = p.station_id and p.timestamp between o.time - interval 1 hour and o.time + interval 1 hour
             qualify row_number() over (partition by o.station_id, o.time
               order by abs(epoch_us(p.timestamp) - epoch_us(o.time)), p.timestamp) = 1)''')}
        select station_id, time, timestamp, {rs(('aqi', 'predicted_aqi'))}, {r('predicted_aqi - aqi', 'error')},
        {r('abs(predicted_aqi - aqi)', 'abs_error')}, {r(_pct, 'pct_error')},
        case when predicted_aqi - aqi > 0 then 'over' when predicted_aqi - aqi <= 0 then 'under' end as direction,
        {label_sql('aqi')} = {label_sql('predicted_aqi')} as category_match,
        case when aqi is null then null when {_pct} < 10 then 'EXCELLENT' when {_pct} < 20 then 'GOOD'
          when {_pct} < 30 then 'FAIR' else 'POOR' end as verdict from j""",
    "stream_alerts": f"""{with_(OBS)} select station_id, time, {r('aqi')}, {bands_sql('aqi', band_keys(1))} as aqi_category,
        {alert_sql('aqi')} as alert_level, {groups_sql('aqi')} as affected_groups from obs where aqi is not null""",
}
