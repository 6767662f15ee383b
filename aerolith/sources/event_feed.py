"""Hourly observation series from event and order-line tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolith.functions.calendar import hour_floor
from aerolith.schema import AIR, KEYS, RAW, TIME, WEATHER

USERS_PER_STATION = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean(value: Column, when: Column, per: float) -> Column:
    """Mean of whole cents, divided once so that the sum stays exact."""
    n = F.count(F.when(when, 1))
    return F.sum(F.when(when, value)) / F.nullif(n, F.lit(0)).cast("double") / F.lit(per)


def station_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.expr(f"cast(user_id div {USERS_PER_STATION} as int)").alias("station_id"),
        hour_floor(F.col("ts")).alias(TIME),
        "event_id",
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("c"),
    )


def hourly_values() -> dict[str, Column]:
    """Aggregates that turn the events of one station hour into an observation."""
    c, kind, third = F.col("c"), F.col("event_type"), F.col("event_id") % 3
    total = F.count(F.lit(1))
    return {
        "temperature_2m": _mean(c, third == 0, 150.0) - 10.0,
        "relative_humidity_2m": (F.sum("user_id") % 101).cast("double"),
        "pressure_msl": F.lit(1000.0) + _mean(c, third == 1, 500.0),
        "wind_speed_10m": _mean(c, third == 2, 400.0),
        "wind_direction_10m": (F.sum("event_id") % 361).cast("double"),
        "precipitation": F.greatest(F.lit(0), F.max("c") - 15000).cast("double") / 10000.0,
        "pm10": _mean(c, kind == "view", 40.0),
        "pm2_5": _mean(c, kind == "click", 100.0),
        "nitrogen_dioxide": _mean(c, kind == "purchase", 100.0),
        "sulphur_dioxide": _mean(c, kind == "signup", 100.0),
        "carbon_monoxide": _mean(c, kind == "error", 10.0),
        "aqi": F.when(total >= 2, F.sum("c") / total.cast("double") / 100.0 + 20.0),
    }


def hourly_observations(events: DataFrame) -> DataFrame:
    """One row per station and hour from a station's first event to its last.

    Events are summed before the shuffle; hours without events are NULL rows.
    """
    ev = station_events(events)
    hours = ev.groupBy(*KEYS, TIME).agg(*[v.alias(n) for n, v in hourly_values().items()])
    span = ev.groupBy(*KEYS).agg(F.min(TIME).alias("lo"), F.max(TIME).alias("hi"))
    grid = span.select(
        *KEYS, F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias(TIME)
    )
    return grid.join(hours, [*KEYS, TIME], "left").select(*KEYS, TIME, *RAW)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_observations(table(spark, sf_dir, "events"))


def weather_observations(obs: DataFrame) -> DataFrame:
    return obs.select(*KEYS, TIME, *WEATHER)


def air_observations(obs: DataFrame) -> DataFrame:
    return obs.select(*KEYS, TIME, *AIR)


def order_series(spark: SparkSession, sf_dir: str, stations: int | None = None) -> DataFrame:
    """Irregular series: one station per supplier, one row per order it serves.

    The order number is the hour, so neighbouring rows lie many hours apart. With ``stations``, suppliers are dealt to
    so many, whose series are long.
    """
    lines = table(spark, sf_dir, "lineitem")
    if stations:
        lines = lines.withColumn("l_suppkey", F.col("l_suppkey") % stations)
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    per = lines.groupBy(F.col("l_suppkey").cast("int").alias("station_id"), F.col("l_orderkey").alias("ok")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(cents("l_extendedprice")).alias("p"),
        F.max(cents("l_discount")).alias("d"),
        F.max(cents("l_tax")).alias("t"),
        F.max("l_partkey").alias("pk"),
    )
    ok, pk, q, p = (F.col(x) for x in ("ok", "pk", "q", "p"))
    keep = lambda cond, v: F.when(cond, v)
    start = F.expr("timestamp_ntz '2000-01-01 00:00:00'")
    return per.select(
        "station_id",
        (start + F.make_dt_interval(F.lit(0), ok.cast("int"))).alias(TIME),
        keep((ok + pk) % 11 != 0, F.col("d") * F.lit(7.0)).alias("temperature_2m"),
        (F.col("t") * F.lit(10.0)).alias("relative_humidity_2m"),
        keep((ok + pk) % 13 != 0, q + F.lit(990.0)).alias("pressure_msl"),
        keep((ok + pk) % 17 != 0, q / F.lit(4.0)).alias("wind_speed_10m"),
        (ok % 361).cast("double").alias("wind_direction_10m"),
        (pk % 3).cast("double").alias("precipitation"),
        keep(pk % 7 >= 2, q + F.lit(6.0)).alias("pm10"),
        keep(ok % 7 >= 2, (q + F.col("t")).cast("double")).alias("pm2_5"),
        (q / F.lit(2.0)).alias("nitrogen_dioxide"),
        (q / F.lit(5.0)).alias("sulphur_dioxide"),
        keep(ok % 5 != 0, p / F.lit(10000.0)).alias("carbon_monoxide"),
        keep(pk % 19 != 0, p / F.lit(25000.0)).alias("aqi"),
    )
