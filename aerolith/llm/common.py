"""Helpers shared by the operators of this folder."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolith.session import drop_dir, shared_dir

# The white space that separates words everywhere in this folder; Python's bytes.split() uses the same six characters.
SPACE = r"[\x20\x09-\x0D]+"
# A key with at least one row in HOT_SHARE of all rows is hot; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so that no other column can clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that the cluster shares and read back: cuts the lineage and survives a lost executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.saved_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``saved`` has written, once nothing reads it any more."""
    drop_dir(table.sparkSession, table.saved_path)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and the number of rows of it.

    The sizes add up to ``total`` at most, so at most HOT_SHARE keys are hot: those are broadcast and their rows stay
    where they are; only the other keys, each with under a thousandth of all rows, are shuffled.
    """
    hot = F.broadcast(groups.filter(F.col(size) * HOT_SHARE >= F.lit(total)))
    cold = groups.filter(F.col(size) * HOT_SHARE < F.lit(total))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


def crc_fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
