"""Range checks, completeness, near-duplicate flags and table profiles."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.functions.calendar import epoch_micros
from aerolith.operators import series as S
from aerolith.schema import INTERPOLATED, KEYS, TIME

# Plausible ranges.
VALID_AQI = (0, 600)
VALID_TEMPERATURE = (-40, 60)
NEAR_DUPLICATE = 0.01
EXPECTED_RANGES = {
    "AQI": ("aqi", "0-600"),
    "Temperature": ("temperature_2m", "-40 to 60°C"),
    "Humidity": ("relative_humidity_2m", "0-100%"),
}


def plausible(columns) -> Column:
    """Whether the values that ``columns`` name are in range; NULL where one is missing."""
    out = F.lit(True)
    if "aqi" in columns:
        out &= F.col("aqi").between(*VALID_AQI)
    if "temperature_2m" in columns:
        out &= F.col("temperature_2m").between(*VALID_TEMPERATURE)
    if {"pm2_5", "pm10"} <= set(columns):
        out &= F.col("pm2_5") <= F.col("pm10")
    return out


def validate_ranges(df: DataFrame) -> DataFrame:
    """Keep plausible rows; a missing value fails its check."""
    return df.filter(plausible(df.columns))


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with any NULL."""
    return df.dropna("any", subset=list(cols) if cols else None)


def feature_range(df: DataFrame, cols=INTERPOLATED, keys=KEYS) -> DataFrame:
    """Max minus min per series.  Gap repair never leaves this range."""
    cols = [c for c in cols if c in df.columns]
    return df.groupBy(*keys).agg(*[(F.max(c) - F.min(c)).alias(f"_range_{c}") for c in cols])


def with_ranges(ready: DataFrame, cols, layout: S.Layout, ranges: DataFrame) -> DataFrame:
    """Add the range of each column to rows prepared for windows.

    A keyed series has all its rows in one task already; otherwise the ranges
    join by size: broadcast when small, else shuffled, where adaptive execution
    splits a hot station.
    """
    if ranges is None and not layout.chunked:
        whole = Window.partitionBy(*layout.by())
        return ready.withColumns({f"_range_{c}": F.max(c).over(whole) - F.min(c).over(whole) for c in cols})
    return ready.join(ranges, [k for k in layout.keys if k in ranges.columns], "left")


def near_duplicate(cols, window, threshold: float = NEAR_DUPLICATE) -> Column:
    """True where every step from the row before is below ``threshold`` of the range.

    Columns without a range are skipped; with none left, or a missing step, false.
    """
    return _all_small({c: step(c, window) for c in cols}, threshold)


def step(name: str, window) -> Column:
    """How far a value lies from that of the row before."""
    return F.abs(F.col(name) - F.lag(name).over(window))


def _all_small(steps: dict[str, Column], threshold: float) -> Column:
    every, some = F.lit(True), F.lit(False)
    for c, far in steps.items():
        spread = F.col(f"_range_{c}")
        varies = F.coalesce(spread > 0, F.lit(False))
        small = F.coalesce(F.try_divide(far, spread) < threshold, F.lit(False))
        every = every & (~varies | small)
        some = some | varies
    return every & some


def flag_steps(df: DataFrame, ranges: DataFrame, cols=INTERPOLATED, keys=KEYS, threshold: float = NEAR_DUPLICATE) -> DataFrame:
    """Rows with kept steps (``_step_x``) get ``is_duplicate`` by the ranges of now instead."""
    cols = [c for c in cols if f"_step_{c}" in df.columns]
    flag = _all_small({c: F.col(f"_step_{c}") for c in cols}, threshold)
    flagged = df.join(ranges, list(keys), "left").withColumn("is_duplicate", flag)
    return flagged.drop(*[f"{p}{c}" for c in cols for p in ("_step_", "_range_")])


def duplicate_weather(
    df: DataFrame,
    cols=INTERPOLATED,
    threshold: float = NEAR_DUPLICATE,
    ranges: DataFrame | None = None,
    layout: S.Layout | None = None,
) -> DataFrame:
    """Add ``is_duplicate``.

    ``ranges`` lets an incremental run use the ranges of the whole series.
    """
    layout = layout or S.choose_layout(df)
    cols = [c for c in cols if c in df.columns]
    if ranges is None and layout.chunked:
        ranges = feature_range(df, cols, layout.keys)
    ready = with_ranges(S.prepare(df, layout, 1), cols, layout, ranges)
    flagged = ready.withColumn("is_duplicate", near_duplicate(cols, layout.window(), threshold))
    return S.finish(flagged, layout).drop(*[f"_range_{c}" for c in cols])


def duplicate_count(df: DataFrame, cols=INTERPOLATED, layout: S.Layout | None = None) -> DataFrame:
    flagged = duplicate_weather(df, cols, layout=layout)
    return flagged.groupBy(*KEYS).agg(F.sum(F.col("is_duplicate").cast("long")).alias("duplicates"))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, and their total as column ``(all)``."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    total = sum((F.col(c) for c in df.columns), F.lit(0).cast("long"))
    return counts.withColumn("(all)", total).unpivot(
        [], [*df.columns, "(all)"], "column_name", "null_count"
    )


def table_profile(df: DataFrame, time: str = TIME) -> DataFrame:
    """Rows, columns, first and last time, and the hours between."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
    ).withColumn(
        "duration_hours",
        (epoch_micros(F.col("max_time")) - epoch_micros(F.col("min_time"))) / F.lit(3.6e9),
    )


def range_report(df: DataFrame, expectations=None) -> DataFrame:
    """Observed minimum and maximum next to the expected range."""
    checks = {k: v for k, v in (expectations or EXPECTED_RANGES).items() if v[0] in df.columns}
    stats = df.agg(
        *[f(c).alias(f"{n}_{a}") for n, (c, _) in checks.items() for a, f in (("lo", F.min), ("hi", F.max))]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("variable"),
                F.col(f"{n}_lo").alias("min_value"),
                F.col(f"{n}_hi").alias("max_value"),
                F.lit(e).alias("expected"),
            )
            for n, (_, e) in checks.items()
        ]
    )
    return stats.select(F.inline(rows))


def forecast_freshness(df: DataFrame, as_of: Column, keys=KEYS, time: str = TIME) -> DataFrame:
    """Rows of a forecast table that are already in the past."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum((F.col(time) <= as_of).cast("long")).alias("past_rows"),
    )
