"""How the rows of a series are spread over tasks.

Most features look back a fixed number of *rows* within a station.  A window
keyed by station is one shuffle and exact, but puts a whole station into one
task.  ``choose_layout`` counts the longest series first; only when that count
is small are windows keyed by station.  Otherwise each series is numbered and
cut into chunks of ``chunk_rows`` rows; a chunk also receives the rows just
before it, so windows inside a chunk see all they need and no task holds more
than a chunk, however many rows one station has.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.functions.calendar import day_number
from aerolith.schema import KEYS, TIME

POS, CHUNK, HALO = "_pos", "_chunk", "_halo"
_BUCKET = "_bucket"
_HOME = "_home"

MAX_SERIES_ROWS = 500_000
CHUNK_ROWS = 50_000
BUCKET_DAYS = 30


@dataclass(frozen=True)
class Layout:
    """``chunk_rows`` is None when every series is known to fit one task."""

    keys: tuple = KEYS
    time: str = TIME
    chunk_rows: int | None = None

    @property
    def chunked(self) -> bool:
        return self.chunk_rows is not None

    def of(self, keys) -> "Layout":
        """The same layout under other key names."""
        return replace(self, keys=tuple(keys))

    def by(self, *more) -> tuple:
        return self.keys + ((CHUNK,) if self.chunked else ()) + more

    def window(self):
        return Window.partitionBy(*self.by()).orderBy(self.time)

    def next_known(self, name: str) -> Column:
        """The next non-NULL value after the current row, in one forward pass."""
        by = ", ".join(f"`{k}`" for k in self.by())
        return F.expr(f"lead(`{name}`) ignore nulls over (partition by {by} order by `{self.time}`)")


def longest_series(df: DataFrame, keys=KEYS) -> int:
    """Rows of the longest series: one aggregate over the key columns."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def choose_layout(
    df: DataFrame,
    keys=KEYS,
    time: str = TIME,
    max_series_rows: int = MAX_SERIES_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Layout:
    """Keyed windows when the longest series is short enough, else chunks."""
    fits = longest_series(df, keys) <= max_series_rows
    return Layout(tuple(keys), time, None if fits else chunk_rows)


def layout_from_span(
    df: DataFrame,
    keys=KEYS,
    time: str = TIME,
    max_series_rows: int = MAX_SERIES_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Layout:
    """The layout for an hourly table, from the time span of its source alone.

    A station has one row per hour, so no series is longer than the span.
    """
    span = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    hours = 0 if span.lo is None else (span.hi - span.lo).total_seconds() / 3600 + 2
    return Layout(tuple(keys), TIME, None if hours <= max_series_rows else chunk_rows)


def number_rows(df: DataFrame, layout: Layout, bucket: str | None = None) -> DataFrame:
    """Add ``_pos``, the 0-based row number in the series, without one task per series.

    Rows are numbered within a bucket (30 days unless an ordered ``bucket``
    column is given) and shifted by the number of rows in earlier buckets.
    """
    keys = list(layout.keys)
    own = bucket is None
    if own:
        bucket = _BUCKET
        df = df.withColumn(bucket, F.floor(day_number(F.col(layout.time)) / BUCKET_DAYS))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # One row per series and bucket: a series has as many as its time span has buckets.
    offsets = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(layout.time)
    out = (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, bucket])
        .withColumn(POS, F.col("_before") + F.col("_rn") - 1)
        .drop("_rn", "_before")
    )
    return out.drop(bucket) if own else out


def into_chunks(
    df: DataFrame, layout: Layout, before: int, after: int = 0, bucket: str | None = None
) -> DataFrame:
    """Cut numbered series into chunks, each with copies of the rows around it."""
    size = layout.chunk_rows
    if max(before, after) > size:
        raise ValueError("a chunk must be longer than the rows looked at around it")
    numbered = number_rows(df, layout, bucket)
    if bucket:
        numbered = numbered.drop(bucket)
    home = F.floor(F.col(POS) / size)
    inside = F.col(POS) % size
    targets = F.array_compact(
        F.array(
            home,
            F.when(inside >= size - before, home + 1),
            F.when((inside < after) & (home > 0), home - 1),
        )
    )
    return (
        numbered.withColumn(_HOME, home)
        .withColumn(CHUNK, F.explode(targets))
        .withColumn(HALO, F.col(CHUNK) != F.col(_HOME))
        .drop(_HOME)
    )


def prepare(df: DataFrame, layout: Layout, before: int, after: int = 0) -> DataFrame:
    """Rows ready for windows over ``layout.window()`` that look this far around."""
    if not layout.chunked:
        return df
    if CHUNK in df.columns:  # filtered chunk rows: renumber inside the chunks they are in
        df = own_rows(df, layout).withColumnRenamed(CHUNK, "_old_chunk").drop(POS, HALO)
        return into_chunks(df, layout, before, after, bucket="_old_chunk")
    return into_chunks(df, layout, before, after)


def own_rows(df: DataFrame, layout: Layout) -> DataFrame:
    """Drop the copies that were only looked back at."""
    return df.filter(~F.col(HALO)) if layout.chunked else df


def finish(df: DataFrame, layout: Layout) -> DataFrame:
    """Drop copies and helper columns."""
    return own_rows(df, layout).drop(POS, CHUNK, HALO)


def with_series(df: DataFrame, columns: dict[str, Column], before: int, layout: Layout | None = None):
    """Add window columns that look back at most ``before`` rows.

    ``columns`` maps names to functions of a window.
    """
    layout = layout or choose_layout(df)
    w = layout.window()
    ready = prepare(df, layout, before)
    return finish(ready.withColumns({name: make(w) for name, make in columns.items()}), layout)


def beyond_chunk(df: DataFrame, values: dict[str, Column], layout: Layout) -> DataFrame:
    """Per chunk, the last value before it and the first after it, as ``_before_x``/``_after_x``.

    ``values`` holds orderable structs that lead with the position; NULLs are
    skipped.  The summary has one row per chunk.
    """
    keys = list(layout.keys)
    ends = own_rows(df, layout).groupBy(*keys, CHUNK).agg(
        *[F.max(v).alias(f"_last_{n}") for n, v in values.items()],
        *[F.min(v).alias(f"_first_{n}") for n, v in values.items()],
    )
    up = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *keys,
        CHUNK,
        *[F.last(f"_last_{n}", ignorenulls=True).over(up).alias(f"_before_{n}") for n in values],
        *[F.last(f"_first_{n}", ignorenulls=True).over(down).alias(f"_after_{n}") for n in values],
    )


def tail(df: DataFrame, rows: int, keys=KEYS, time: str = TIME) -> DataFrame:
    """Last ``rows`` rows of each series; Spark trims each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= rows).drop("_rn")


def head_from(df: DataFrame, start: Column, rows: int, keys=KEYS, time: str = TIME) -> DataFrame:
    """First ``rows`` rows of each series at or after ``start``."""
    w = Window.partitionBy(*keys).orderBy(time)
    return (
        df.filter(F.col(time) >= start)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= rows)
        .drop("_rn")
    )


def dedupe_last(df: DataFrame, order: str = "ingest_seq", keys=(*KEYS, TIME)) -> DataFrame:
    """Keep the row ingested last for each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
