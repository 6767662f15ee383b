"""Connected components of an edge table."""

from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node that can be reached.

    Large and small stars in turn: neighbours move to the smallest one they know, until every node points at its root.
    Each round is written, so a lost executor costs one round. Neighbours are reduced by partial aggregates and joins
    that adaptive execution splits; a node with many neighbours is never gathered.
    """
    now = saved(_pairs(edges.select("a", "b")), "edges")
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        before, now = now, saved(_small_star(_large_star(now)), "edges")
        discard(before)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def _pairs(edges: DataFrame) -> DataFrame:
    a, b = edges.columns
    return edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest neighbour, itself included."""
    both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("hi").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    return both.filter("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, move to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    return _pairs(edges.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("hi").alias("a"), F.col("m").alias("b"))))
