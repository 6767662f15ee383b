"""Feature columns and model matrices."""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from aerolith.functions.bands import clip
from aerolith.functions.calendar import calendar_columns, cyclical_columns
from aerolith.operators import series as S
from aerolith.schema import (
    CHANGE_HOURS,
    FEED_TARGET,
    LAGS,
    LEAKING,
    MODEL_FEATURES,
    POLLUTANTS,
    RATE_HOURS,
    SEASONS,
    SINGLE_PRECISION,
    TARGET,
    TIME,
)


def rename_target(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(FEED_TARGET, TARGET)


def time_features(df: DataFrame, tz: str = "UTC", time: str = TIME) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(time), tz))


def cyclical(df: DataFrame) -> DataFrame:
    return df.withColumns(cyclical_columns())


def interactions(df: DataFrame) -> DataFrame:
    out = {}
    if {"temperature_2m", "relative_humidity_2m"} <= set(df.columns):
        out["temp_humidity_interaction"] = F.col("temperature_2m") * F.col("relative_humidity_2m")
    if {"wind_speed_10m", "pressure_msl"} <= set(df.columns):
        out["wind_pressure_interaction"] = F.col("wind_speed_10m") * F.col("pressure_msl")
    return df.withColumns(out) if out else df


LAG_ROWS = max(n for ns in LAGS.values() for n in ns)
CHANGE_ROWS = 1 + max(CHANGE_HOURS)


def lag_columns(df: DataFrame, window) -> dict[str, Column]:
    """Rows ago within the series, as positions and not as clock hours."""
    return {
        f"{c}_lag_{n}h": F.lag(c, n).over(window)
        for c, ns in LAGS.items()
        if c in df.columns
        for n in ns
    }


def change_columns(window, value: str = TARGET) -> dict[str, Column]:
    """Change of the target over N rows, ending one row ago."""
    last = F.lag(value, 1).over(window)
    return {f"{value}_change_{n}h": last - F.lag(value, 1 + n).over(window) for n in CHANGE_HOURS}


def rate_columns(value: str = TARGET) -> dict[str, Column]:
    """Change per hour, 0 when unknown, clamped to -10..10."""
    return {
        f"{value}_rate_{n}h": clip(
            F.coalesce(F.col(f"{value}_change_{n}h") / F.lit(float(n)), F.lit(0.0)), -10.0, 10.0
        )
        for n in RATE_HOURS
    }


def lag_features(df: DataFrame, layout: S.Layout | None = None) -> DataFrame:
    layout = layout or S.choose_layout(df)
    ready = S.prepare(df, layout, LAG_ROWS)
    return S.finish(ready.withColumns(lag_columns(df, layout.window())), layout)


def change_rates(df: DataFrame, layout: S.Layout | None = None) -> DataFrame:
    layout = layout or S.choose_layout(df)
    ready = S.prepare(df, layout, CHANGE_ROWS)
    return S.finish(ready.withColumns(change_columns(layout.window())), layout).withColumns(rate_columns())


PCT_PERIODS = (1, 24)


def pct_change(df: DataFrame, value: str = TARGET, layout: S.Layout | None = None) -> DataFrame:
    """Percent change of the value one row ago over 1 and 24 rows.

    Gaps are first padded with the last known value, however old.  NULL becomes
    0, the result is clamped to -1..1, and a step up from 0 counts as +1.
    """
    layout = layout or S.choose_layout(df)
    look_back = 1 + max(PCT_PERIODS)
    ready = S.prepare(df, layout, look_back)
    w = layout.window()
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    padded = ready.withColumn("_pad", F.last(value, ignorenulls=True).over(running))
    if layout.chunked:
        # Rows before the first known value of a chunk continue the chunks before it.
        # Looked-back copies need the value known before *them*, so the padding is
        # settled on the chunk's own rows and spread to the neighbours afterwards.
        own = S.own_rows(padded, layout)
        edges = S.beyond_chunk(
            own, {"v": F.when(F.col(value).isNotNull(), F.struct(S.POS, F.col(value).alias("v")))}, layout
        )
        in_chunk = Window.partitionBy(*layout.by()).orderBy(layout.time).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        own = own.withColumn("_pad", F.last(value, ignorenulls=True).over(in_chunk))
        own = own.join(edges.select(*layout.by(), "_before_v"), list(layout.by()), "left")
        own = own.withColumn("_pad", F.coalesce("_pad", F.col("_before_v.v"))).drop("_before_v")
        padded = S.prepare(own, layout, look_back)
    now = F.lag("_pad", 1).over(w)
    out = {}
    for n in PCT_PERIODS:
        then = F.lag("_pad", 1 + n).over(w)
        change = F.when(then == 0, F.signum(now)).otherwise(F.try_divide(now, then) - 1)
        out[f"{value}_pct_change_{n}h"] = clip(F.coalesce(change, F.lit(0.0)), -1.0, 1.0)
    return S.finish(padded.withColumns(out), layout).drop("_pad")


def season_onehot(df: DataFrame) -> DataFrame:
    """Replace ``season`` by one 0/1 column per season."""
    flags = {f"season_{i}": (F.col("season") == s).cast("int") for i, s in enumerate(SEASONS)}
    return df.withColumns(flags).drop("season")


def leakage_guard(df: DataFrame) -> DataFrame:
    """Drop any column naming a pollutant unless it is a lag."""
    bad = [c for c in df.columns if "lag" not in c and any(p in c for p in POLLUTANTS)]
    return df.drop(*bad)


def numeric_only(df: DataFrame) -> DataFrame:
    """Numeric and boolean columns, without the store's ``_id``."""
    keep = [
        f.name
        for f in df.schema
        if f.name != "_id" and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    return df.select(*keep)


def model_matrix(df: DataFrame, keep=()) -> DataFrame:
    """Features and target as a model sees them.

    Time and everything known only together with the target is dropped, except
    the columns named in ``keep``.
    """
    out = season_onehot(df) if "season" in df.columns else df
    return out.drop(*[c for c in (TIME, *LEAKING) if c not in keep])


def align_features(df: DataFrame, names=MODEL_FEATURES, keep=()) -> DataFrame:
    """Exactly the model's features in order; missing columns and NULLs become 0."""
    cols = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
        for c in names
    ]
    return df.select(*keep, *cols)


def to_single_precision(df: DataFrame, cols=SINGLE_PRECISION) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in cols if c in df.columns})
