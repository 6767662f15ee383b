"""The model registry as a table: upsert, best and latest versions, purge; models are saved beside it and loaded by name."""

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from aerolith.operators import pipelines
from aerolith.schema import REGISTRY

NAMED = ("name", "version")
# Fixed value: what marks rows that training has written.
SOURCE = "training_pipeline"


def upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """One row per name and version; the one saved last wins."""
    rows = registry.unionByName(new)
    rest = [c for c in rows.columns if c not in NAMED]
    last = rows.groupBy(*NAMED).agg(F.max_by(F.struct(*rest), F.col("saved_at")).alias("r"))
    return last.select(*NAMED, "r.*").select(*registry.columns)


def latest(registry: DataFrame) -> DataFrame:
    """The highest version of each model."""
    w = Window.partitionBy("name").orderBy(F.col("version").desc())
    return registry.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def best(registry: DataFrame, metric: str, order: str = "min") -> DataFrame:
    """The version of each model with the best metric, else its latest version."""
    value = F.nanvl(F.try_element_at(F.col("metrics"), F.lit(metric)), F.lit(None).cast("double"))
    ranked = value.asc_nulls_last() if order == "min" else value.desc_nulls_last()
    w = Window.partitionBy("name").orderBy(ranked, F.col("version").desc())
    return registry.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def purge(registry: DataFrame, names) -> DataFrame:
    """The registry without the versions of the named models."""
    return registry.filter(~F.col("name").isin(list(names)))


def metrics_merge(base: Column, over: Column) -> Column:
    """Both maps as one; where both have a key, ``over`` wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def metric_rows(registry: DataFrame, *more) -> DataFrame:
    """One row per model version and metric."""
    return registry.select("name", "version", *more, F.explode("metrics").alias("metric", "value"))


def entries(ranked: DataFrame, feature_names, path: str, saved_at: Column, registry: DataFrame | None = None) -> DataFrame:
    """Registry rows of ranked model metrics: one per model, all metrics as a map.

    A model's version is one above its highest in ``registry``, else 1; its place is a folder of that name and version
    below ``path``.
    """
    numbers = [c for c, t in ranked.dtypes if t == "double"]
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in numbers]))
    rows = ranked.select(
        F.replace(F.lower(F.trim("model")), F.lit(" "), F.lit("_")).alias("name"),
        F.col("model").alias("display_name"),
        F.lit(1).cast("int").alias("version"),
        "best_model",
        F.lit(path).alias("_base"),
        F.array(*[F.lit(n) for n in feature_names]).alias("feature_names"),
        F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("metrics"),
        F.lit(SOURCE).alias("registry_source"),
        saved_at.alias("saved_at"),
    )
    if registry is not None:
        known = registry.groupBy("name").agg(F.max("version").alias("_known"))
        next_version = (F.coalesce("_known", F.lit(0)) + 1).cast("int")
        rows = rows.join(known, "name", "left").withColumn("version", next_version)
    place = F.concat_ws("/", "_base", "name", F.concat(F.lit("v"), F.col("version").cast("string")))
    return rows.withColumn("filesystem_path", place).select(*REGISTRY.names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The registry kept at ``path``; of rows for one name and version the one saved last."""
    rows = spark.read.schema(REGISTRY).parquet(path)
    return upsert(rows, rows.limit(0))


def add(rows: DataFrame, path: str) -> None:
    """Add registry rows to those kept at ``path``; readers see all of them or none."""
    rows.select(*REGISTRY.names).write.mode("append").parquet(path)


def find(registry: DataFrame, name: str, version: int | None = None, metric: str | None = None, order: str = "min"):
    """The registry row of a model: of the given version, else the best by ``metric``, else the latest; None if unknown."""
    named = registry.filter(F.col("name") == name)
    if version is not None:
        named = named.filter(F.col("version") == version)
    return (best(named, metric, order) if metric else latest(named)).first()


def load(registry: DataFrame, name: str, version: int | None = None, metric: str | None = None, order: str = "min") -> PipelineModel:
    """The saved model of a registry row, as ``find`` chooses it."""
    row = find(registry, name, version, metric, order)
    if row is None:
        raise ValueError(f"no model {name}" + (f" of version {version}" if version is not None else ""))
    return pipelines.load(row["filesystem_path"])
