"""Joins of feeds, and of forecasts to what was then observed."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.functions.bands import aqi_label
from aerolith.functions.calendar import day_number, epoch_micros
from aerolith.schema import KEYS, TIME


def join_feeds(weather: DataFrame, air: DataFrame, keys=(*KEYS, TIME)) -> DataFrame:
    """Hours known to both feeds.  The hour is part of the key, so no station is hot."""
    return weather.join(air, list(keys), "inner")


def last_run(predicted: DataFrame, keys=KEYS) -> DataFrame:
    """One prediction for each time: that of the last run, then the lower value."""
    runs = ["generated_at"] if "generated_at" in predicted.columns else []
    order = F.struct(*runs, (-F.col("predicted_aqi")).alias("low"))
    return predicted.groupBy(*keys, "timestamp").agg(F.max_by("predicted_aqi", order).alias("predicted_aqi"))


def nearest_by_hour(predicted: DataFrame, tolerance_hours: int = 1, keys=KEYS) -> DataFrame:
    """For each hour within the tolerance of a prediction the one that ``nearest_match`` gives it.

    A table without observations, so that a stream of hours can be joined to it.
    """
    t = F.col("timestamp")
    gap = F.expr(f"interval {int(tolerance_hours)} hour")
    low = F.date_trunc("hour", t - gap).cast("timestamp_ntz")
    hours = F.sequence(low, F.date_trunc("hour", t + gap).cast("timestamp_ntz"), F.expr("interval 1 hour"))
    each = last_run(predicted, keys).withColumn(TIME, F.explode(hours)).filter(F.col(TIME) >= t - gap)
    off = F.abs(epoch_micros(t) - epoch_micros(F.col(TIME)))
    return each.groupBy(*keys, TIME).agg(
        F.min_by(F.struct("timestamp", "predicted_aqi"), F.struct(off, "timestamp")).alias("p")
    ).select(*keys, TIME, "p.*")


def nearest_match(
    actual: DataFrame, predicted: DataFrame, tolerance_hours: int = 1, keys=KEYS
) -> DataFrame:
    """Each observed hour with the prediction closest in time, if within tolerance.

    Both sides are merged in time order and each observation looks at the
    prediction before and after it: no pairs are formed.  Series are cut into
    days; a prediction goes to every day that its tolerance reaches.  Of two
    equally close predictions the earlier wins; of several for one time, that of
    the last run (``generated_at``, if there is one), then the lower value.
    """
    gap = F.expr(f"interval {int(tolerance_hours)} hour")
    days = lambda t: F.sequence(day_number(t - gap), day_number(t + gap))
    predicted = last_run(predicted, keys)
    blank = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    a = actual.select(
        *keys,
        day_number(F.col(TIME)).alias("_day"),
        F.col(TIME).alias("_at"),
        F.col("aqi"),
        F.lit(None).cast("struct<timestamp:timestamp_ntz,predicted_aqi:double>").alias("_p"),
    )
    p = predicted.select(
        *keys,
        F.explode(days(F.col("timestamp"))).alias("_day"),
        F.col("timestamp").alias("_at"),
        blank("aqi", actual),
        F.struct("timestamp", "predicted_aqi").alias("_p"),
    )
    by = [*keys, "_day"]
    rank = F.col("_p").isNull().cast("int")  # predictions before observations of the same time
    w = Window.partitionBy(*by).orderBy("_at", rank)
    following = F.expr(
        f"lead(_p) ignore nulls over (partition by {', '.join(by)} order by _at, cast(_p is null as int))"
    )
    near = (
        a.unionByName(p)
        .withColumns(
            {
                "_prev": F.last("_p", ignorenulls=True).over(
                    w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                ),
                "_next": following,
            }
        )
        .filter(F.col("_p").isNull())
    )
    off = lambda c: F.abs(epoch_micros(F.col(f"{c}.timestamp")) - epoch_micros(F.col("_at")))
    before, after = off("_prev"), off("_next")
    best = F.when(after.isNull() | (before <= after), F.col("_prev")).otherwise(F.col("_next"))
    offset = F.least(before, after)
    ok = offset <= int(tolerance_hours) * 3_600_000_000
    return near.withColumns({"_best": F.when(ok, best), "_off": F.when(ok, offset)}).select(
        *keys,
        F.col("_at").alias(TIME),
        F.col("aqi"),
        F.col("_best.timestamp").alias("timestamp"),
        F.col("_best.predicted_aqi").alias("predicted_aqi"),
        (F.col("_off") / 1_000_000).alias("offset_seconds"),
    )


def closest_row(df: DataFrame, at: Column, keys=KEYS, time: str = TIME) -> DataFrame:
    """Per series the row closest to ``at``; of equals the earliest."""
    distance = F.abs(epoch_micros(F.col(time)) - epoch_micros(at))
    row = F.struct(*[c for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(distance, F.col(time))).alias("r"))
    return best.select(*keys, "r.*")


def rows_of(features: DataFrame, raw: DataFrame, keys=(*KEYS, TIME)) -> DataFrame:
    """The raw rows behind feature rows."""
    return raw.join(features.select(*keys), list(keys), "inner")


def error_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """Signed, absolute and percent error, direction, category match and verdict."""
    error = predicted - actual
    pct = F.try_divide(F.abs(error), actual) * 100
    known = actual.isNotNull() & predicted.isNotNull()
    return {
        "error": error,
        "abs_error": F.abs(error),
        "pct_error": pct,
        "direction": F.when(error > 0, "over").when(known, "under"),
        "category_match": aqi_label(actual) == aqi_label(predicted),
        "verdict": F.when(~known, None)
        .when(pct < 10, "EXCELLENT")
        .when(pct < 20, "GOOD")
        .when(pct < 30, "FAIR")
        .otherwise("POOR"),
    }


def forecast_error(matched: DataFrame, actual: str = "aqi", predicted: str = "predicted_aqi") -> DataFrame:
    return matched.withColumns(error_columns(F.col(actual), F.col(predicted)))
