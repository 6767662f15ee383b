"""Fixed band tables as frames, and lookups into them."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolith.functions.bands import (
    BANDS,
    HEALTH_ADVICE,
    RANGES,
    UI_ADVICE,
    aqi_category,
)


def _table(spark: SparkSession, names, rows) -> DataFrame:
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def bands(spark: SparkSession) -> DataFrame:
    """Six rows: bounds, key, label, printed range and colour of each band."""
    rows = [(key, label, rng, colour) for (_, key, label, colour), rng in zip(BANDS, RANGES)]
    return _table(spark, ("category_key", "category", "aqi_range", "colour"), rows)


def health_advice_table(spark: SparkSession) -> DataFrame:
    names = ("category_key", "description", "general_public", "sensitive_groups", "children_elderly")
    return _table(spark, names, [(k, *v) for k, v in HEALTH_ADVICE.items()])


def ui_advice_table(spark: SparkSession) -> DataFrame:
    names = ("category_key", "general", "sensitive", "activity", "precautions")
    return _table(spark, names, [(k, *v) for k, v in UI_ADVICE.items()])


def _lookup(df: DataFrame, dim: DataFrame, value: str) -> DataFrame:
    """Join a six-row table, which is always small enough to broadcast."""
    keyed = df.withColumn("category_key", aqi_category(F.col(value)))
    return keyed.join(F.broadcast(dim), "category_key", "left")


def category_lookup(df: DataFrame, value: str = "aqi") -> DataFrame:
    return _lookup(df, bands(df.sparkSession), value)


def health_advice(df: DataFrame, value: str = "aqi") -> DataFrame:
    dim = bands(df.sparkSession).join(F.broadcast(health_advice_table(df.sparkSession)), "category_key")
    return _lookup(df, dim, value)


def ui_advice(df: DataFrame, value: str = "aqi") -> DataFrame:
    return _lookup(df, ui_advice_table(df.sparkSession), value)
