"""Long series cut by time: a row knows its bucket, and the buckets beside it that look at it, from its own time alone.

Windows then run within a bucket and the rows around it, all in one shuffle, whatever the length of a series; no row is
numbered. What lies around a bucket must settle the bucket's own rows: before it more than ``SURE_ROWS`` rows that are
complete and valid as observed, or all rows there are; after it a known value of every interpolated column, unless none
follows at all. One aggregate finds the buckets where that does not hold (gaps, sparse stretches). Those are joined with
the bucket before or after them, so that the result is exact for any series.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.functions.calendar import epoch_micros
from aerolith.operators.quality import plausible
from aerolith.schema import (
    AIR_FILL_LIMIT,
    CHANGE_HOURS,
    INTERPOLATED,
    KEYS,
    LAGS,
    MEDIAN_ROWS,
    RAW,
    TIME,
)

# Complete rows ahead of an hour so that nothing before them matters for it: those that lags and changes reach, and those
# that a median and its forward fill reach.
SURE_ROWS = max(1 + max(CHANGE_HOURS), *(max(n) for n in LAGS.values())) + MEDIAN_ROWS + AIR_FILL_LIMIT

BUCKET, OWN = "_bucket_no", "_own_row"
HOUR = 3_600_000_000
# Joined buckets up to this number are sent to all tasks, more are shuffled.
MOST_SENT = 100_000


@dataclass(frozen=True)
class TimeBuckets:
    """Hours of a bucket, and how many before and after it are looked at."""

    hours: int = 365 * 24
    before: int = 14 * 24
    after: int = 3 * 24
    keys: tuple = KEYS
    time: str = TIME

    def __post_init__(self):
        if not 0 < max(self.before, self.after) <= self.hours:
            raise ValueError("what is looked at around a bucket must be some hours, and no more than a bucket has")

    def number(self) -> Column:
        at = epoch_micros(F.col(self.time))
        return ((at - F.pmod(at, F.lit(self.hours * HOUR))) / F.lit(self.hours * HOUR)).cast("long")

    def inside(self) -> Column:
        """Microseconds since the bucket began."""
        return F.pmod(epoch_micros(F.col(self.time)), F.lit(self.hours * HOUR))


def _weather(df: DataFrame) -> list[str]:
    return [c for c in INTERPOLATED if c in df.columns]


def summary(df: DataFrame, buckets: TimeBuckets) -> DataFrame:
    """A row per series and bucket: what its ends hold for the buckets beside it, and the extremes of each column."""
    weather, inside = _weather(df), buckets.inside()
    at = epoch_micros(F.col(buckets.time))
    whole = [F.col(c).isNotNull() for c in RAW if c in df.columns]
    sure = F.coalesce(reduce(lambda a, b: a & b, [*whole, plausible(df.columns)]), F.lit(False))
    head, tail = inside < buckets.after * HOUR, inside >= (buckets.hours - buckets.before) * HOUR
    return df.groupBy(*buckets.keys, buckets.number().alias(BUCKET)).agg(
        F.count_if(sure & tail).alias("_sure"),
        F.min(at).alias("_lo"),
        *[F.max(F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in weather],
        *[F.coalesce(F.bool_or(F.col(c).isNotNull() & head), F.lit(False)).alias(f"_head_{c}") for c in weather],
        *[f(c).alias(f"_{n}_{c}") for c in weather for n, f in (("min", F.min), ("max", F.max))],
    )


def ranges(table: DataFrame, weather, keys=KEYS) -> DataFrame:
    """Max minus min per series of each column, from a ``summary``."""
    spread = lambda c: (F.max(f"_max_{c}") - F.min(f"_min_{c}")).alias(f"_range_{c}")
    return table.groupBy(*keys).agg(*[spread(c) for c in weather])


def joined(table: DataFrame, weather, buckets: TimeBuckets) -> DataFrame:
    """``keys, bucket, group``: the buckets that must be computed together with one before them, from a ``summary``.

    ``group`` is the first of the buckets that belong together. A series has as many rows here as it has buckets.
    """
    of = Window.partitionBy(*buckets.keys)
    line = of.orderBy(BUCKET)
    start = F.col(BUCKET) * F.lit(buckets.hours * HOUR)
    end = start + F.lit(buckets.hours * HOUR)
    beside = lambda c, step: F.when(F.lag(BUCKET, step).over(line) == F.col(BUCKET) - step, F.lag(c, step).over(line))
    first = F.min("_lo").over(of)
    unsure = (first < start - buckets.before * HOUR) & (F.coalesce(beside("_sure", 1), F.lit(0)) <= SURE_ROWS)
    open_end = F.lit(False)
    for c in weather:
        more = F.max(f"_last_{c}").over(of) >= end + buckets.after * HOUR
        open_end |= F.coalesce(more, F.lit(False)) & ~F.coalesce(beside(f"_head_{c}", -1), F.lit(False))
    ends = table.select(*buckets.keys, BUCKET, unsure.alias("_unsure"), open_end.alias("_open"))
    alone = ~(F.col("_unsure") | F.coalesce(F.lag("_open").over(line), F.lit(False)))
    running = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = ends.withColumn("_start", F.when(alone | (F.row_number().over(line) == 1), F.col(BUCKET)))
    grouped = started.withColumn("_group", F.last("_start", ignorenulls=True).over(running))
    return grouped.filter(F.col("_group") != F.col(BUCKET)).select(*buckets.keys, BUCKET, "_group")


def spread(df: DataFrame, buckets: TimeBuckets, together: DataFrame | None = None) -> DataFrame:
    """Every row in its own bucket, and as a copy (``_own_row`` false) in those beside it that look at it.

    ``together`` lists joined buckets as ``joined`` does; None if there are none.
    """
    inside = buckets.inside()
    place = lambda number, own: F.struct(number.alias(BUCKET), F.lit(own).alias(OWN))
    number = F.col("_home")
    targets = F.array_compact(
        F.array(
            place(number, True),
            F.when(inside >= (buckets.hours - buckets.before) * HOUR, place(number + 1, False)),
            F.when(inside < buckets.after * HOUR, place(number - 1, False)),
        )
    )
    rows = df.withColumn("_home", buckets.number())
    if together is None:
        return rows.select(*df.columns, F.inline(targets))
    # Copies within a group would be repeated rows: what a row looks like from its own group is the row itself.
    home = together.select(*buckets.keys, F.col(BUCKET).alias("_home"), F.col("_group").alias("_home_group"))
    rows = rows.join(home, [*buckets.keys, "_home"], "left")
    placed = rows.select(*df.columns, F.coalesce("_home_group", "_home").alias("_home_group"), F.inline(targets))
    found = placed.join(together, [*buckets.keys, BUCKET], "left").withColumn(BUCKET, F.coalesce("_group", BUCKET))
    return found.filter(F.col(OWN) | (F.col(BUCKET) != F.col("_home_group"))).select(*df.columns, BUCKET, OWN)
