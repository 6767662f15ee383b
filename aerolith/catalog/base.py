"""Inputs shared by the catalog, as DataFrames and as SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from aerolith.operators import series as S
from aerolith.schema import KEYS, RAW, TIME, WEATHER
from aerolith.sources import event_feed

ID = ("station_id", "time")
DIGITS = 6
BORDER = 0.4973


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.observations(spark, sf_dir)


def layout_of(spark: SparkSession, sf_dir: str) -> S.Layout:
    """Observations are hourly, so the time span of the events bounds a series."""
    return S.layout_from_span(event_feed.table(spark, sf_dir, "events"), time="ts")


def order_layout(spark: SparkSession, sf_dir: str) -> S.Layout:
    """A supplier has at most one row per order line."""
    return S.choose_layout(event_feed.table(spark, sf_dir, "lineitem"), ["l_suppkey"]).of(KEYS)


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_feed.order_series(spark, sf_dir)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles so that both engines print the same value.

    Ties are common in products of short decimals and engines break them
    differently, so the border lies a little above one half.
    """
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = F.lit(10.0**digits)
            c = (F.floor(c.cast("double") * scale + BORDER).cast("double") / scale).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def r(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    """The SQL side of ``rounded``."""
    return f"floor(({expr}) * 1e{digits} + {BORDER}e0) / 1e{digits} as {name or expr}"


def rs(names, digits: int = DIGITS) -> str:
    return ", ".join(r(n, n, digits) for n in names)


def with_(*ctes: str) -> str:
    """Join CTE lists into one WITH clause."""
    return "with " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())


# SQL of hourly observations from events.
OBS = """
ev as (
  select cast(user_id // 50 as int) as station_id, date_trunc('hour', ts) as time, event_id, user_id, event_type,
         cast(round(value * 100) as bigint) as c
  from events),
span as (select station_id, min(time) as lo, max(time) as hi from ev group by station_id),
grid as (select station_id, unnest(generate_series(lo, hi, interval 1 hour)) as time from span),
hourly as (
  select station_id, time,
    sum(c) filter (where event_id % 3 = 0) / cast(nullif(count(*) filter (where event_id % 3 = 0), 0) as double) / 150e0 - 10e0 as temperature_2m,
    cast(sum(user_id) % 101 as double) as relative_humidity_2m,
    1000e0 + sum(c) filter (where event_id % 3 = 1) / cast(nullif(count(*) filter (where event_id % 3 = 1), 0) as double) / 500e0 as pressure_msl,
    sum(c) filter (where event_id % 3 = 2) / cast(nullif(count(*) filter (where event_id % 3 = 2), 0) as double) / 400e0 as wind_speed_10m,
    cast(sum(event_id) % 361 as double) as wind_direction_10m,
    cast(greatest(0, max(c) - 15000) as double) / 10000e0 as precipitation,
    sum(c) filter (where event_type = 'view') / cast(nullif(count(*) filter (where event_type = 'view'), 0) as double) / 40e0 as pm10,
    sum(c) filter (where event_type = 'click') / cast(nullif(count(*) filter (where event_type = 'click'), 0) as double) / 100e0 as pm2_5,
    sum(c) filter (where event_type = 'purchase') / cast(nullif(count(*) filter (where event_type = 'purchase'), 0) as double) / 100e0 as nitrogen_dioxide,
    sum(c) filter (where event_type = 'signup') / cast(nullif(count(*) filter (where event_type = 'signup'), 0) as double) / 100e0 as sulphur_dioxide,
    sum(c) filter (where event_type = 'error') / cast(nullif(count(*) filter (where event_type = 'error'), 0) as double) / 10e0 as carbon_monoxide,
    case when count(*) >= 2 then sum(c) / cast(count(*) as double) / 100e0 + 20e0 end as aqi
  from ev group by station_id, time),
obs as (
  select g.station_id, g.time, temperature_2m, relative_humidity_2m, pressure_msl, wind_speed_10m, wind_direction_10m,
         precipitation, pm10, pm2_5, nitrogen_dioxide, sulphur_dioxide, carbon_monoxide, aqi
  from grid g left join hourly h on g.station_id = h.station_id and g.time = h.time)
"""

# SQL of the irregular series from order lines.
ORDER_SERIES = """
lines as (
  select cast(l_suppkey as int) as station_id, l_orderkey as ok, sum(cast(l_quantity as bigint)) as q,
         sum(cast(round(l_extendedprice * 100) as bigint)) as p, max(cast(round(l_discount * 100) as bigint)) as d,
         max(cast(round(l_tax * 100) as bigint)) as t, max(l_partkey) as pk
  from lineitem group by 1, 2),
obs as (
  select station_id, timestamp '2000-01-01 00:00:00' + to_hours(cast(ok as int)) as time,
    case when (ok + pk) % 11 <> 0 then d * 7e0 end as temperature_2m,
    t * 10e0 as relative_humidity_2m,
    case when (ok + pk) % 13 <> 0 then q + 990e0 end as pressure_msl,
    case when (ok + pk) % 17 <> 0 then q / 4e0 end as wind_speed_10m,
    cast(ok % 361 as double) as wind_direction_10m,
    cast(pk % 3 as double) as precipitation,
    case when pk % 7 >= 2 then q + 6e0 end as pm10,
    case when ok % 7 >= 2 then cast(q + t as double) end as pm2_5,
    q / 2e0 as nitrogen_dioxide, q / 5e0 as sulphur_dioxide,
    case when ok % 5 <> 0 then p / 10000e0 end as carbon_monoxide,
    case when pk % 19 <> 0 then p / 25000e0 end as aqi
  from lines)
"""


def predictions(obs: DataFrame) -> DataFrame:
    """Forecasts off the hour, made from the observations: 4 of 5 hours, some far off."""
    hour = F.hour(TIME)
    minutes = (hour * 7 + F.col("station_id") * 11) % 50
    return obs.filter(hour % 5 != 0).select(
        *KEYS,
        (F.col(TIME) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("timestamp"),
        (F.coalesce("aqi", F.lit(75.0)) + (hour * 13 % 41) - 20).alias("predicted_aqi"),
    )


PREDICTIONS = """
pred as (
  select station_id, time + to_minutes(cast((hour(time) * 7 + station_id * 11) % 50 as int)) as timestamp,
         coalesce(aqi, 75e0) + (hour(time) * 13 % 41) - 20 as predicted_aqi
  from obs where hour(time) % 5 <> 0)
"""


def with_copies(obs: DataFrame) -> DataFrame:
    """Every seventh hour arrives twice; the later copy is one higher."""
    first = obs.withColumn("ingest_seq", F.lit(0))
    again = obs.filter(F.hour(TIME) % 7 == 0).withColumn("ingest_seq", F.lit(1))
    return first.unionByName(again.withColumns({c: F.col(c) + 1 for c in RAW}))


COPIES = f"""
copies as (
  select *, 0 as ingest_seq from obs union all
  select station_id, time, {", ".join(f"{c} + 1" for c in RAW)}, 1 from obs where hour(time) % 7 = 0)
"""

FORECAST_HOURS = 72


def forecast_start(obs: DataFrame) -> DataFrame:
    """Per station the first of its last 72 hours."""
    return obs.groupBy(*KEYS).agg(
        (F.max(TIME) - F.expr(f"interval {FORECAST_HOURS - 1} hours")).alias("start")
    )


def split_forecast(obs: DataFrame):
    """History and the weather of the last 72 hours, which plays the forecast."""
    dated = obs.join(forecast_start(obs), list(KEYS))
    history = dated.filter(F.col(TIME) < F.col("start")).select(*obs.columns)
    future = dated.filter(F.col(TIME) >= F.col("start")).select(*KEYS, TIME, *WEATHER)
    return history, future


SPLIT_FORECAST = f"""
starts as (select station_id, max(time) - interval {FORECAST_HOURS - 1} hour as start from obs group by station_id),
history as (select o.* from obs o join starts s on o.station_id = s.station_id where o.time < s.start),
future as (select o.station_id, o.time, {", ".join(WEATHER)} from obs o join starts s on o.station_id = s.station_id
           where o.time >= s.start)
"""

# A linear model with fixed weights stands for a trained one where results are compared with SQL.
INTERCEPT = 30.0
WEIGHTS = {
    "temperature_2m": 0.15,
    "relative_humidity_2m": -0.05,
    "pressure_msl": 0.02,
    "wind_speed_10m": -0.1,
    "wind_direction_10m": 0.005,
    "precipitation": -1.5,
    "hour": 0.1,
    "is_weekend": 1.5,
    "is_daytime": -2.0,
    "hour_sin": 3.0,
    "hour_cos": -2.0,
    "day_of_week_sin": 0.5,
    "month_cos": 1.0,
    "pm2_5_lag_1h": 0.2,
    "pm2_5_lag_3h": 0.05,
    "pm2_5_lag_6h": 0.03,
    "pm2_5_lag_12h": 0.04,
    "pm2_5_lag_24h": 0.06,
    "carbon_monoxide_lag_1h": 0.004,
    "carbon_monoxide_lag_3h": 0.003,
    "carbon_monoxide_lag_24h": 0.002,
    "temperature_2m_lag_12h": 0.05,
    "pressure_msl_lag_12h": -0.01,
    "aqi_change_1h": 0.1,
    "aqi_change_3h": 0.05,
    "aqi_change_6h": 0.02,
    "aqi_change_24h": 0.04,
    "aqi_rate_1h": 0.3,
    "aqi_rate_3h": 0.2,
    "aqi_rate_24h": -0.4,
    "temp_humidity_interaction": 0.0005,
    "wind_pressure_interaction": 0.0001,
    "season_0": 4.0,
    "season_2": -3.0,
}
