"""SimHash near-dedup by multi-index hashing: Hamming balls of fingerprint segments, table matches, whole distances."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import batch, documents, join_by_hot_key, saved
from aerolith.llm.graph import components

SHINGLE = 3
SEED = 42
# Two fingerprints at 2 or fewer differing bits have a half in which they differ at 1 bit or none.
MAX_BITS = 2
# A table bucket with more fingerprints than this is not paired but searched through shared neighbours.
BUCKET = 16


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """A bit is 1 if over half of the shingle hashes have it; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - k + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]
    set_bits = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, len(values), 1 << 16):
        block = values[i : i + (1 << 16)]
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * set_bits > len(values), bitorder="little").view(np.uint64)[0])


_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: one row per row of ``docs``; the 64 bits are a signed long."""

    def run(batches):
        for b in batches:
            values = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(_FINGERPRINTS, b.column(0), pa.array(values.view(np.int64)))

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints ``fp`` at MAX_BITS or fewer differing bits.

    Each half is a table keyed by its value. A fingerprint looks up the ball of radius 1 around each of its halves
    (clearing bits only: of two values one bit apart, one is reached by clearing) and the whole distance decides.
    Buckets above ``bucket`` would give pairs by the square: every fingerprint that looks one up instead meets the
    others at the values within one bit of the whole fingerprint. Two fingerprints share such a value exactly if they
    differ at 2 bits or fewer, at most 65 share one, and a star per value keeps them connected.
    """
    halves = fps.selectExpr("fp", "posexplode(array(shiftrightunsigned(fp, 32), fp & 4294967295L)) as (half, value)")
    ball = (
        "concat(array(value), transform(filter(sequence(0, 31), i -> getbit(value, i) = 1), i -> value ^ shiftleft(1L, i)))"
    )
    probes = halves.selectExpr("fp as a", "half", f"explode({ball}) as value")
    hot = halves.groupBy("half", "value").count().filter(F.col("count") > bucket).select("half", "value")
    keys = ["half", "value"]
    table = halves.join(hot, keys, "left_anti").withColumnRenamed("fp", "b")
    whole = (F.col("a") != F.col("b")) & (F.expr("bit_count(a ^ b)") <= MAX_BITS)
    near = probes.join(table, keys).filter(whole).select("a", "b")
    crowded = probes.join(hot, keys, "left_semi").select(F.col("a").alias("fp")).distinct()
    points = crowded.selectExpr(
        "fp", "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) as point"
    )
    stars = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    met = stars.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter("a != b").select("a", "b")
    return near.unionByName(met)


def near_dedup(docs: DataFrame, k: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words and ``k``-word shingles, repeats included; a shorter text is one
    shingle, a text without words (null, empty) has fingerprint zero and is linked like any other. Documents linked
    at 2 or fewer differing bits, directly or through others, share the smallest ``doc_id`` as component; null ids
    get the component of their fingerprint. Repeated rows share a fingerprint. Empty tables give empty results.
    """
    fps = saved(fingerprints(docs, k), "fingerprints")
    groups = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-groups")
    roots = saved(components(links(groups.select("fp"), bucket)), "fingerprint-roots")
    least = roots.join(groups, roots["node"] == groups["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component")
    labels = saved(
        groups.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n"), "labels"
    )
    return join_by_hot_key(fps, labels, "fp", "n", fps.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
