"""Chronological splits and standardisation."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.schema import TIME

TRAIN, VALIDATION, TEST = "train", "val", "test"


def split_times(df: DataFrame, n_splits: int = 5, test_size: float = 0.10, time: str = TIME) -> DataFrame:
    """One row: the first validation time and the first test time.

    The last ``test_size`` of the rows are for testing and, of the rest, the last
    1 / (n_splits + 1) for validation.  Rows are counted per hour, hours are
    numbered within months, so no task sorts the table; all stations of an hour
    fall on the same side.
    """
    hours = df.groupBy(time).agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.trunc(time, "month"))
    earlier = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    months = hours.groupBy("m").agg(F.sum("n").alias("n_m"))
    offsets = months.select(
        "m",
        F.coalesce(F.sum("n_m").over(earlier), F.lit(0)).alias("before_m"),
        F.sum("n_m").over(Window.partitionBy()).alias("total"),  # one row per month
    )
    inside = Window.partitionBy("m").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before_m") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = hours.join(offsets, "m").select(time, "total", before.alias("before"))
    n_rest = F.col("total") - F.floor(F.col("total") * F.lit(test_size))
    n_train = n_rest - F.floor(n_rest / (n_splits + 1))
    return placed.agg(
        F.min(F.when(F.col("before") >= n_train, F.col(time))).alias("val_start"),
        F.min(F.when(F.col("before") >= n_rest, F.col(time))).alias("test_start"),
    )


def time_split(df: DataFrame, n_splits: int = 5, test_size: float = 0.10, time: str = TIME) -> DataFrame:
    """Add ``split``: train, val or test.  The two cut times are found first."""
    cut = split_times(df, n_splits, test_size, time).first()
    side = F.lit(TRAIN)
    for start, name in ((cut.val_start, VALIDATION), (cut.test_start, TEST)):
        if start is not None:
            side = F.when(F.col(time) >= F.lit(str(start)).cast(df.schema[time].dataType), name).otherwise(side)
    return df.withColumn("split", side)


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column, as fitted."""

    means: dict
    deviations: dict

    def transform(self, df: DataFrame) -> DataFrame:
        """Standardise; a column without variation is only centred."""
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(m)) / F.lit(self.deviations[c] or 1.0)
                for c, m in self.means.items()
                if m is not None
            }
        )


def fit_scaler(df: DataFrame, cols) -> Scaler:
    """One aggregate over the rows to fit on."""
    row = df.agg(
        *[f(c).alias(f"{a}_{c}") for c in cols for a, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    return Scaler({c: row[f"m_{c}"] for c in cols}, {c: row[f"s_{c}"] for c in cols})


def scale(df: DataFrame, cols, fit_on: Column | None = None) -> DataFrame:
    """Standardise the columns by the rows of ``fit_on``."""
    return fit_scaler(df if fit_on is None else df.filter(fit_on), cols).transform(df)
