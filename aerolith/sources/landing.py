"""Hourly feed responses: one value array per variable from a start time on."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolith.functions.calendar import day_number, epoch_micros, hours_after
from aerolith.operators.series import dedupe_last
from aerolith.schema import AIR, FEED_TARGET, KEYS, TIME, WEATHER, landing_record

BATCH_DAYS = 90


def _epoch(seconds: Column) -> Column:
    """Naive UTC time of epoch seconds, whatever the session's zone."""
    start = F.expr("timestamp_ntz '1970-01-01 00:00:00'")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def read_landing(spark: SparkSession, path: str, variables) -> DataFrame:
    return spark.read.schema(landing_record(variables)).json(path)


def decode(records: DataFrame, variables, *keep) -> DataFrame:
    """One row per hour of each response; NaN becomes NULL.  ``keep`` names more columns to show."""
    zipped = F.arrays_zip(*variables)
    more = [c for c in keep if c != "start_epoch"]
    rows = records.select("station_id", "start_epoch", *more, F.posexplode(zipped).alias("_i", "_v"))
    value = lambda v: F.when(~F.isnan(F.col(f"_v.{v}")), F.col(f"_v.{v}")).alias(v)
    time = hours_after(_epoch(F.col("start_epoch")), F.col("_i")).alias(TIME)
    return rows.select("station_id", time, *[value(v) for v in variables], *keep)


def decode_weather(records: DataFrame, *keep) -> DataFrame:
    """Observed or forecast weather."""
    return decode(records, WEATHER, *keep)


def decode_air(records: DataFrame, *keep) -> DataFrame:
    """Pollutants; the feed's target variable takes its own name here."""
    feed = [*AIR[:-1], FEED_TARGET]
    return decode(records, feed, *keep).withColumnRenamed(FEED_TARGET, AIR[-1])


def to_landing(obs: DataFrame, variables, batch_days: int = BATCH_DAYS, names=None) -> DataFrame:
    """Feed responses of an hourly table: one per station and batch of days.

    A response holds at most ``batch_days`` x 24 hours, as the feed's do.
    """
    names = names or {}
    item = F.struct(F.col(TIME), *variables)
    rows = F.array_sort(F.collect_list(item))
    batch = F.floor(day_number(F.col(TIME)) / batch_days)
    packed = obs.groupBy(*KEYS, batch.alias("_batch")).agg(rows.alias("_rows"), F.min(TIME).alias("_start"))
    return packed.select(
        *KEYS,
        F.floor(epoch_micros(F.col("_start")) / 1_000_000).alias("start_epoch"),
        *[F.col(f"_rows.{v}").alias(names.get(v, v)) for v in variables],
    )


def backfill_batches(spans: DataFrame, batch_days: int = BATCH_DAYS, start: str = "start", end: str = "end"):
    """Cut [start, end) of each row into batches that share their boundary day."""
    step = F.expr(f"interval {int(batch_days)} days")
    lows = F.when(
        F.col(start) < F.col(end), F.sequence(F.col(start), F.date_sub(F.col(end), 1), step)
    )
    rest = [c for c in spans.columns if c not in (start, end)]
    return spans.select(*rest, F.col(end).alias("_end"), F.posexplode(lows).alias("batch", "batch_start")).select(
        *rest,
        (F.col("batch") + 1).alias("batch"),
        "batch_start",
        F.least(F.date_add("batch_start", batch_days), F.col("_end")).alias("batch_end"),
    )


def union_batches(batches, keys=(*KEYS, TIME), order: str = "ingest_seq") -> DataFrame:
    """All batches together, the row of the later batch where days overlap."""
    numbered = [b.withColumn(order, F.lit(i)) for i, b in enumerate(batches)]
    out = numbered[0]
    for b in numbered[1:]:
        out = out.unionByName(b)
    return dedupe_last(out, order, keys).drop(order)
