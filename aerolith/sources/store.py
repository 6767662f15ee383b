"""Feature tables on Parquet: keyed upsert, append, range scans, views, exports.

A table is partitioned by month and by a shard of the station key, so a write
touches few files and a range scan reads only its months.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolith.operators.split import TRAIN, time_split
from aerolith.schema import KEYS, PREDICTION_RECORD, TARGET, TIME
from aerolith.functions.bands import aqi_category
from aerolith.session import drop_dir, shared_dir, written

MONTH, SHARD = "part_month", "part_shard"
SHARDS = 32
ORDER = "ingest_seq"
DELETED = "is_deleted"
_DAY = "_day"


def placed(df: DataFrame, shards: int = SHARDS, keys=KEYS) -> DataFrame:
    """Rows with the partition they belong to."""
    return df.withColumns(
        {
            MONTH: F.date_format(TIME, "yyyy-MM"),
            SHARD: F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"),
        }
    )


def _by_day(df: DataFrame) -> DataFrame:
    """One shuffle by partition and day keeps files few and splits a hot station by time."""
    return df.withColumn(_DAY, F.dayofmonth(TIME)).repartition(MONTH, SHARD, _DAY)


def _write(df: DataFrame, path: str, mode: str) -> None:
    writer = df.drop(_DAY).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(MONTH, SHARD).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, path: str, shards: int = SHARDS, keys=KEYS) -> None:
    """Add rows; nothing is written for an empty frame."""
    if not df.isEmpty():
        _write(_by_day(placed(df, shards, keys)), path, "append")


def partitions_of(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``table`` in the partitions that the placed ``rows`` belong to; months and shards without any are not read."""
    found = rows.agg(F.collect_set(MONTH).alias("months"), F.collect_set(SHARD).alias("shards")).first()
    some = table.filter(F.col(MONTH).cast("string").isin(found["months"]) & F.col(SHARD).isin(found["shards"]))
    return some.join(rows.select(MONTH, SHARD).distinct(), [MONTH, SHARD], "left_semi")


def upsert(df: DataFrame, path: str, shards: int = SHARDS, keys=KEYS) -> None:
    """Insert or replace rows by (keys, time); the highest ``ingest_seq`` wins.

    The rows are computed once; only the partitions that receive any are read and replaced.  They are
    swapped in when the job commits, so a lost executor leaves the old ones.
    """
    spark = df.sparkSession
    new, stage = placed(df, shards, keys), None
    if exists(spark, path):
        stage = shared_dir(spark, "upsert")
        new = written(new, stage)
        new = new.unionByName(partitions_of(read_table(spark, path), new), allowMissingColumns=True)
    # Grouping by the shuffle's columns as well lets the same shuffle serve both steps.
    key = [MONTH, SHARD, _DAY, *keys, TIME]
    row = F.struct(*[c for c in new.columns if c not in key])
    latest = _by_day(new).groupBy(*key).agg(F.max_by(row, F.col(ORDER)).alias("r")).select(*key, "r.*")
    _write(latest, path, "overwrite")
    if stage:
        drop_dir(spark, stage)


def plain(table: DataFrame) -> DataFrame:
    """Live rows without the columns that only place them, and without ``_id``."""
    live = table.filter(~F.coalesce(F.col(DELETED), F.lit(False))) if DELETED in table.columns else table
    return live.drop(MONTH, SHARD, ORDER, DELETED, "_id")


def range_scan(table: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows with start <= time <= end; months outside are not read."""
    out = table.filter(F.col(TIME).between(start, end))
    if MONTH in table.columns:
        month = lambda t: F.date_format(t, "yyyy-MM")
        out = out.filter(F.col(MONTH).between(month(start), month(end)))
    return out


def latest(table: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    """Rows of the last ``hours`` hours before ``as_of``, and any after."""
    since = as_of - F.expr(f"interval {int(hours)} hours")
    out = table.filter(F.col(TIME) >= since)
    return out.filter(F.col(MONTH) >= F.date_format(since, "yyyy-MM")) if MONTH in table.columns else out


def feature_view(table: DataFrame, name: str, label: str = TARGET):
    """Register the table as a view; returns its features and its label by key."""
    if label not in table.columns:
        raise ValueError(f"no label column {label}")
    table.createOrReplaceTempView(name)
    key = [c for c in (*KEYS, TIME) if c in table.columns]
    view = table.sparkSession.table(name)
    return view.drop(label), view.select(*key, label)


def training_dataset(table: DataFrame, path: str, start: Column = None, end: Column = None) -> None:
    """Write the rows of a time range as CSV with a split column."""
    if start is not None:
        table = table.filter(F.col(TIME) >= start)
    if end is not None:
        table = table.filter(F.col(TIME) <= end)
    time_split(table).write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def read_training(spark: SparkSession, path: str, schema, split: str = TRAIN) -> DataFrame:
    """One split of a training dataset; the others are not read."""
    return spark.read.schema(schema).option("header", True).csv(path).filter(F.col("split") == split)


def csv_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def prediction_records(pred: DataFrame, generated_at: Column) -> DataFrame:
    """One nested record per station and forecast run; a run has a fixed number of hours."""
    item = F.struct("timestamp", "predicted_aqi", aqi_category(F.col("predicted_aqi")).alias("aqi_category"))
    return pred.groupBy(*KEYS, generated_at.alias("generated_at")).agg(
        F.array_sort(F.collect_list(item)).alias("predictions")
    )


def write_predictions(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The cached predictions, one row each."""
    records = spark.read.schema(PREDICTION_RECORD).json(path)
    return records.select(*KEYS, "generated_at", F.inline("predictions"))
