"""Feature chains: the order of steps from raw hours to feature tables."""

from pyspark.sql import DataFrame, functions as F

from aerolith.operators import buckets as B, features as X, impute, quality, series as S
from aerolith.schema import INTERPOLATED
from aerolith.session import shared_dir, written


def features_full(
    df: DataFrame,
    tz: str = "UTC",
    layout: S.Layout | None = None,
    ranges: DataFrame | None = None,
    interpolated: bool = True,
    pct_change: bool = False,
    keep_steps: bool = False,
) -> DataFrame:
    """Repair, flag, validate, then calendar, lags, momentum and interactions.

    Lags count the rows that survive validation.  Short series are one shuffle of whole series; a chunked layout cuts
    them into buckets of so many hours, which hold no more rows than that.  ``keep_steps`` keeps the steps that the
    near-duplicate flag compares with the range (``_step_x``) in place of the flag.
    """
    layout = layout or S.choose_layout(df)
    if layout.chunked:
        hours = layout.chunk_rows
        cut = B.TimeBuckets(hours, min(hours, B.TimeBuckets.before), min(hours, B.TimeBuckets.after), layout.keys, layout.time)
        return features_bucketed(df, cut, tz, ranges, interpolated, pct_change, keep_steps)
    weather = [c for c in INTERPOLATED if c in df.columns]
    w = layout.window()
    repaired = impute.repair(df, layout, interpolated)
    if keep_steps:
        flagged = repaired.withColumns({f"_step_{c}": quality.step(c, w) for c in weather})
    else:
        ranged = quality.with_ranges(repaired, weather, layout, ranges)
        flagged = ranged.withColumn("is_duplicate", quality.near_duplicate(weather, w))
    valid = quality.validate_ranges(flagged).drop(*[f"_range_{c}" for c in weather])
    out = valid.withColumns({**X.lag_columns(valid, w), **X.change_columns(w)}).withColumns(X.rate_columns())
    if pct_change:
        out = X.pct_change(out, layout=layout)
    out = X.interactions(X.cyclical(X.time_features(out, tz)))
    return quality.drop_incomplete(out, [c for c in out.columns if not c.startswith("_step_")])


def features_bucketed(
    df: DataFrame,
    buckets: B.TimeBuckets = B.TimeBuckets(),
    tz: str = "UTC",
    ranges: DataFrame | None = None,
    interpolated: bool = True,
    pct_change: bool = False,
    keep_steps: bool = False,
) -> DataFrame:
    """The same chain over series of any length: two passes over ``df``, the second one with one shuffle.

    The first pass is one aggregate to a row per series and bucket; it gives the ranges of whole series and tells which
    buckets must be taken together. A series without complete rows ends up in one piece, and has no features.
    """
    weather = [c for c in INTERPOLATED if c in df.columns]
    spark = df.sparkSession
    table = written(B.summary(df, buckets), shared_dir(spark, "bucket-summary"))
    together = written(B.joined(table, weather, buckets), shared_dir(spark, "joined-buckets"))
    n = together.count()
    together = None if n == 0 else F.broadcast(together) if n <= B.MOST_SENT else together
    whole = S.Layout((*buckets.keys, B.BUCKET), buckets.time)
    known = ranges if ranges is not None else B.ranges(table, weather, buckets.keys)
    out = features_full(B.spread(df, buckets, together), tz, whole, known, interpolated, pct_change, keep_steps)
    return out.filter(B.OWN).drop(B.BUCKET, B.OWN)


def features_forecast(df: DataFrame, tz: str = "UTC", layout: S.Layout | None = None) -> DataFrame:
    """Weather-only features of a forecast: repair, calendar, cyclical, interactions."""
    out = impute.handle_missing(df, layout)
    return X.interactions(X.cyclical(X.time_features(out, tz)))
