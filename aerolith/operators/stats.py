"""Exploratory statistics and forecast summaries."""

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.functions.bands import aqi_label
from aerolith.functions.calendar import calendar_columns, epoch_micros, to_local
from aerolith.operators import series as S
from aerolith.operators.quantiles import exact_quantiles
from aerolith.schema import KEYS, TIME

# Features and lags examined against the target.
LAG_CANDIDATES = (
    "pm2_5",
    "pm10",
    "carbon_monoxide",
    "nitrogen_dioxide",
    "sulphur_dioxide",
    "temperature_2m",
    "pressure_msl",
    "wind_speed_10m",
    "relative_humidity_2m",
)
CORRELATION_LAGS = (1, 2, 3, 6, 12, 24, 48)
INFORMATION_LAGS = (1, 3, 6, 12, 24)


def _local(time: str, tz: str) -> Column:
    return F.col(time) if tz == "UTC" else to_local(F.col(time), tz)


def daily_avg(df: DataFrame, value: str = "aqi", tz: str = "UTC", keys=KEYS) -> DataFrame:
    day = F.to_date(_local(TIME, tz)).alias("date")
    return df.groupBy(*keys, day).agg(F.avg(value).alias(f"avg_{value}"))


def historical_summary(
    df: DataFrame, as_of: Column, days: int, value: str = "aqi", tz: str = "UTC", keys=KEYS
) -> DataFrame:
    """Average, extremes, range and rows of the ``days`` + 1 dates ending the day before ``as_of``."""
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    local = _local(TIME, tz)
    first = F.date_sub(F.to_date(as_of), days + 1).cast("timestamp_ntz")
    end = F.to_date(as_of).cast("timestamp_ntz")
    return (
        df.filter((local >= first) & (local < end))
        .groupBy(*keys)
        .agg(
            F.avg(value).alias("avg_aqi"),
            F.max(value).alias("max_aqi"),
            F.min(value).alias("min_aqi"),
            F.count(F.lit(1)).alias("row_count"),
        )
        .withColumn("aqi_range", F.col("max_aqi") - F.col("min_aqi"))
    )


def seasonal_avg(df: DataFrame, part: str, value: str = "aqi", tz: str = "UTC", keys=()) -> DataFrame:
    """Mean by ``hour``, ``day_of_week`` (Monday 0) or ``month``."""
    return df.groupBy(*keys, calendar_columns(F.col(TIME), tz)[part].alias(part)).agg(
        F.avg(value).alias(f"avg_{value}")
    )


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of each column."""
    quartiles = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                *[F.lit(q).cast("double").alias(a) for a, q in zip(("q25", "q50", "q75"), quartiles[c])],
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in cols
        ]
    )
    return stats.select(F.inline(F.array(*[F.col(f"`{c}`") for c in cols])))


def target_stats(df: DataFrame, value: str = "aqi") -> DataFrame:
    (median,) = exact_quantiles(df, [value], (0.5,))[value]
    return df.agg(
        F.avg(value).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.stddev_samp(value).alias("std"),
    )


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation of complete pairs; NULL where a side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _paired(df: DataFrame, keys, cells, **agg) -> DataFrame:
    """Aggregate many column pairs at once.

    ``cells`` holds (names, x, y).  Each row is unfolded into one row per pair,
    counted before the shuffle: the plan stays small for any number of pairs
    and at most groups x pairs rows move.
    """
    names = list(cells[0][0])
    unfolded = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in labels.items()], x.cast("double").alias("x"), y.cast("double").alias("y"))
            for labels, x, y in cells
        ]
    )
    long = df.select(*keys, F.inline(unfolded))
    return long.groupBy(*keys, *names).agg(*[v.alias(n) for n, v in agg.items()])


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson correlations of all columns."""
    cells = [
        ({"feature": a, "other": b}, F.col(a), F.col(b)) for a, b in combinations_with_replacement(cols, 2)
    ]
    half = _paired(df, (), cells, corr=_corr(F.col("x"), F.col("y")))
    mirrored = F.array_distinct(
        F.array(F.struct("feature", "other"), F.struct(F.col("other").alias("feature"), F.col("feature").alias("other")))
    )
    return half.select(F.inline(mirrored), "corr")


def _one(df: DataFrame, **columns) -> Column:
    """Global aggregates as one scalar struct, usable in any expression."""
    return df.agg(F.struct(*[v.alias(n) for n, v in columns.items()]).alias("s")).scalar()


def histogram(df: DataFrame, value: str = "aqi", bins: int = 50) -> DataFrame:
    """Counts in equal bins from minimum to maximum; the last bin holds the maximum."""
    edges = df.agg(F.min(value).alias("mn"), F.max(value).alias("mx")).select(
        F.struct(
            F.when(F.col("mn") < F.col("mx"), F.col("mn")).otherwise(F.col("mn") - 0.5).alias("lo"),
            F.when(F.col("mn") < F.col("mx"), F.col("mx")).otherwise(F.col("mx") + 0.5).alias("hi"),
        ).alias("s")
    )
    e = edges.scalar()
    place = F.floor(F.lit(float(bins)) * (F.col(value) - e["lo"]) / (e["hi"] - e["lo"])).cast("int")
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("s.hi") - F.col("s.lo")) / F.lit(float(bins))
    frame = edges.select("s", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("s.lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("s.lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def category_counts(df: DataFrame, value: str = "aqi") -> DataFrame:
    """Rows per AQI band and their share in percent, most frequent first."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(aqi_label(F.col(value)).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy())  # at most one row per band
    return counts.withColumn("share_pct", F.col("n") * 100.0 / total).orderBy(F.desc("n"), "category")


def iqr_bounds(df: DataFrame, value: str = "aqi", k: float = 1.5) -> tuple:
    q1, q3 = exact_quantiles(df, [value], (0.25, 0.75))[value]
    return (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def outliers_iqr(df: DataFrame, value: str = "aqi", k: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than ``k`` times their distance."""
    lo, hi = iqr_bounds(df, value, k)
    return df.filter((F.col(value) < F.lit(lo)) | (F.col(value) > F.lit(hi)))


def outliers_zscore(df: DataFrame, value: str = "aqi", z: float = 3.0) -> DataFrame:
    """Rows further than ``z`` population deviations from the mean."""
    s = _one(df, mean=F.avg(value), sd=F.stddev_pop(value))
    score = F.try_divide(F.abs(F.col(value) - s["mean"]), s["sd"])
    return df.filter(score > z)


def outlier_report(df: DataFrame, value: str = "aqi") -> DataFrame:
    """Outlier counts and percentages by both rules."""
    lo, hi = iqr_bounds(df, value)
    s = _one(df, mean=F.avg(value), sd=F.stddev_pop(value))
    v = F.col(value)
    counted = df.agg(
        F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias("iqr_outliers"),
        F.count_if(F.try_divide(F.abs(v - s["mean"]), s["sd"]) > 3).alias("zscore_outliers"),
        F.count(F.lit(1)).alias("row_count"),
    )
    pct = lambda c: (F.col(c) * 100.0 / F.col("row_count"))
    return counted.withColumns({"iqr_pct": pct("iqr_outliers"), "zscore_pct": pct("zscore_outliers")})


def _lagged(df, features, target, lags, layout):
    """One struct of lagged features per lag: one window for all of them."""
    layout = layout or S.choose_layout(df)
    ready = S.prepare(df, layout, max(lags)).withColumn("_now", F.struct(*features))
    w = layout.window()
    ready = ready.withColumns({f"_l{n}": F.lag("_now", n).over(w) for n in lags})
    return S.finish(ready, layout).select(*KEYS, target, *[f"_l{n}" for n in lags])


def lag_crosscorr(
    df: DataFrame,
    features=LAG_CANDIDATES,
    target: str = "aqi",
    lags=CORRELATION_LAGS,
    layout: S.Layout | None = None,
    keys=KEYS,
) -> DataFrame:
    """Correlation of each feature N rows ago with the target now."""
    rows = _lagged(df, features, target, lags, layout)
    cells = [
        ({"feature": f, "lag": n}, F.col(f"_l{n}.{f}"), F.col(target)) for f in features for n in lags
    ]
    return _paired(rows, keys, cells, corr=_corr(F.col("x"), F.col("y")))


def _binned(value: Column, lo: float | None, hi: float | None, bins: int) -> Column:
    """Equal-width bin from 0; everything in bin 0 where there is no width."""
    if lo is None or lo == hi:
        return F.when(value.isNotNull(), F.lit(0))
    place = F.floor(F.lit(float(bins)) * (value - F.lit(lo)) / F.lit(hi - lo)).cast("int")
    return F.least(place, F.when(value.isNotNull(), F.lit(bins - 1)))


def lag_mutual_info(
    df: DataFrame,
    features=LAG_CANDIDATES,
    target: str = "aqi",
    lags=INFORMATION_LAGS,
    bins: int = 16,
    layout: S.Layout | None = None,
) -> DataFrame:
    """Mutual information of each feature N rows ago with the target, from binned counts.

    Values are binned before they are lagged, and pairs are counted before the
    shuffle, so at most features x lags x bins x bins groups move.
    """
    cols = [*features, target]
    e = df.agg(
        *[f(c).cast("double").alias(f"{a}_{c}") for c in cols for a, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    binned = df.select(
        *KEYS, TIME, *[_binned(F.col(c), e[f"lo_{c}"], e[f"hi_{c}"], bins).alias(c) for c in cols]
    )
    rows = _lagged(binned, features, target, lags, layout or S.choose_layout(df))
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.lit(n).alias("lag"), F.col(f"_l{n}.{f}").alias("x"))
            for f in features
            for n in lags
        ]
    )
    pairs = (
        rows.filter(F.col(target).isNotNull())
        .select(F.col(target).alias("y"), F.inline(cells))
        .filter(F.col("x").isNotNull())
    )
    joint = pairs.groupBy("feature", "lag", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    by = lambda *more: Window.partitionBy("feature", "lag", *more)
    n, nx, ny, total = (
        F.col("n"),
        F.sum("n").over(by("x")),
        F.sum("n").over(by("y")),
        F.sum("n").over(by()),
    )
    term = n / total * F.ln(n * total / (nx.cast("double") * ny))
    return joint.withColumn("t", term).groupBy("feature", "lag").agg(F.sum("t").alias("mutual_info"))


def forecast_daily(pred: DataFrame, keys=KEYS, tz: str = "UTC") -> DataFrame:
    return pred.groupBy(*keys, F.to_date(_local("timestamp", tz)).alias("date")).agg(
        F.min("predicted_aqi").alias("min_aqi"),
        F.max("predicted_aqi").alias("max_aqi"),
        F.avg("predicted_aqi").alias("avg_aqi"),
        F.count("predicted_aqi").alias("hours"),
    )


def forecast_kpis(pred: DataFrame, keys=KEYS) -> DataFrame:
    """Peak and low (the first of equals), mean, and their categories."""
    item = F.struct(F.col("timestamp"), F.col("predicted_aqi"))
    since = epoch_micros(F.col("timestamp"))
    out = pred.groupBy(*keys).agg(
        F.max_by(item, F.struct(F.col("predicted_aqi"), -since)).alias("peak"),
        F.min_by(item, F.struct(F.col("predicted_aqi"), since)).alias("low"),
        F.avg("predicted_aqi").alias("avg_aqi"),
        F.count(F.lit(1)).alias("forecast_hours"),
    )
    return out.select(
        *keys,
        F.col("peak.predicted_aqi").alias("peak_aqi"),
        F.col("peak.timestamp").alias("peak_time"),
        aqi_label(F.col("peak.predicted_aqi")).alias("peak_category"),
        F.col("low.predicted_aqi").alias("low_aqi"),
        F.col("low.timestamp").alias("low_time"),
        aqi_label(F.col("low.predicted_aqi")).alias("low_category"),
        "avg_aqi",
        aqi_label(F.col("avg_aqi")).alias("avg_category"),
        "forecast_hours",
    )


def metric_columns(actual: str, predicted: str) -> dict[str, Column]:
    a, p = F.col(actual), F.col(predicted)
    both = a.isNotNull() & p.isNotNull()
    y = F.when(both, a)
    e = p - a
    n = F.count(F.when(both, 1))
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": 1.0 - F.try_divide(F.sum(e * e), F.var_pop(y) * n),
    }


def regression_metrics(scored: DataFrame, by=(), actual: str = "aqi", predicted: str = "predicted_aqi"):
    """RMSE, MAE and R² of complete pairs, per group."""
    cols = [v.alias(n) for n, v in metric_columns(actual, predicted).items()]
    return scored.groupBy(*by).agg(*cols)


def feature_scores(df: DataFrame, features, target: str = "aqi", keys=KEYS) -> DataFrame:
    """Absolute correlation of each feature with the target, per series, 0 without variation."""
    cells = [({"feature_name": f}, F.col(f), F.col(target)) for f in features]
    score = F.coalesce(F.abs(_corr(F.col("x"), F.col("y"))), F.lit(0.0))
    return _paired(df, keys, cells, importance_score=score)


def top_features(scores: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` highest scores, names breaking ties; kept per partition before they meet."""
    return scores.orderBy(F.desc("importance_score"), "feature_name").limit(n)


def top_of_map(scores: Column, n: int) -> Column:
    """The ``n`` entries of a map with the highest values, names breaking ties."""
    entries = F.transform(
        F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))
    )
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: e["k"])
