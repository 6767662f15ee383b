"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import batch, discard, saved

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SALT = 8, 10, 64, 1024, "3"
# Beyond this, a squared distance over many dimensions may not fit a long.
LARGEST = 2**26
# Rows whose lists are walked together.
BLOCK = 4096


class CentroidLists:
    """Per dimension the centroids in order of their value, and who they are."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.who = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.who, 0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each vector; the smaller number wins ties.

        Threshold algorithm: in every dimension the sorted list is walked outward from the vector's value, one centroid
        a step. A centroid met for the first time in any list has its exact distance computed. The squared distances
        of the walk's frontier add up to a lower bound for all centroids not met; a vector is done when that sum
        strictly exceeds its best exact distance, so that an equally near centroid of smaller number is still found.
        """
        number = np.zeros(len(vectors), np.int32)
        distance = np.zeros(len(vectors), np.int64)
        for at in range(0, len(vectors), BLOCK):
            number[at : at + BLOCK], distance[at : at + BLOCK] = self._walk(vectors[at : at + BLOCK])
        return number, distance

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.centroids.shape
        far = np.int64(2) ** 62
        best = np.full(len(vectors), far)
        best_number = np.zeros(len(vectors), np.int32)
        met = np.zeros((len(vectors), k), bool)
        alive = np.arange(len(vectors))
        every_dim = np.arange(dims)
        right = np.stack([np.searchsorted(self.values[:, j], vectors[:, j]) for j in every_dim], axis=1)
        left = right - 1
        v = vectors
        for _ in range(k):
            below = np.where(left >= 0, v - self.values[np.maximum(left, 0), every_dim], far)
            above = np.where(right < k, self.values[np.minimum(right, k - 1), every_dim] - v, far)
            down = below <= above
            step = np.where(down, left, right)
            frontier = np.where(down, below, above)
            left = left - down
            right = right + ~down
            now = np.zeros((len(alive), k), bool)
            now[np.arange(len(alive))[:, None], self.who[step, every_dim]] = True
            now &= ~met[alive]
            met[alive] |= now
            for c in range(k):
                rows = np.flatnonzero(now[:, c])
                if len(rows):
                    gap = v[rows] - self.centroids[c]
                    exact = np.einsum("ij,ij->i", gap, gap)
                    who = alive[rows]
                    better = (exact < best[who]) | ((exact == best[who]) & (c < best_number[who]))
                    best[who[better]] = exact[better]
                    best_number[who[better]] = c
            going = np.einsum("ij,ij->i", frontier, frontier) <= best[alive]
            if not going.any():
                break
            alive, v, left, right = alive[going], v[going], left[going], right[going]
        return best_number, best


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the vectors of ``dims`` components, none null or not finite, each as floor(scale * x)."""
    given = F.col(vector_column).cast("array<double>")
    usable = F.coalesce(
        (F.size(given) == dims) & F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
        F.lit(False),
    )
    large = F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))
    whole = lambda x: F.when(F.abs(scale * x) <= LARGEST, F.floor(F.lit(float(scale)) * x)).otherwise(large.cast("long"))
    return rows.filter(usable).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(given, whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The vectors with the smallest sha256 of ``salt:id``, in that order; equal hashes go by id and components.

    A hash below a bound that a count gives is enough, so the driver is sent a few rows and not some of every partition.
    """
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    n = vectors.count()
    found, share = [], min(1.0, 16 * k / max(n, 1))
    while True:
        # The first 8 digits of the hash are uniform; a little more than the share that holds k rows is asked for.
        few = hashed if share >= 1 else hashed.filter(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") < int(share * 2**32))
        same = few.groupBy("hash", "vec_id", "v").agg(F.count("*").alias("copies"))
        found = [r["v"] for r in same.orderBy("hash", "vec_id", "v").limit(k).collect() for _ in range(min(k, r["copies"]))][:k]
        if len(found) >= min(k, n) or share >= 1:
            return np.array(found, np.int64)
        share *= 16


@dataclass(frozen=True)
class Moved:
    """The centroids after a round, and how many vectors each had."""

    centroids: np.ndarray
    sizes: np.ndarray


_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def move(vectors: DataFrame, centroids: np.ndarray) -> Moved:
    """One round: each centroid becomes the floor of the mean of its vectors; one without vectors stays.

    A task adds up its own vectors, so what is shuffled is a row per task, cluster and dimension.
    """
    k, dims = centroids.shape

    def run(batches):
        lists = CentroidLists(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            v = _matrix(b.column(0), dims)
            number, _ = lists.nearest(v)
            n += np.bincount(number, minlength=k)
            for c in np.unique(number):
                sums[c] += v[number == c].sum(axis=0)
        yield batch(_SUMS, np.arange(k, dtype=np.int32), n, pa.array(list(sums), pa.list_(pa.int64())))

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "x")).groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    )
    out, sizes = centroids.copy(), np.zeros(k, np.int64)
    for r in added.collect():  # k * dims rows
        sizes[r["cluster"]] = r["n"]
        if r["n"]:
            out[r["cluster"], r["dim"]] = int(r["x"]) // r["n"]
    return Moved(out, sizes)


_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""

    def run(batches):
        lists = CentroidLists(centroids)
        for b in batches:
            yield batch(_ASSIGNED, b.column(0), *lists.nearest(_matrix(b.column(1), centroids.shape[1])))

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_clusters(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
    salt: str = SALT,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` for every usable vector.

    Vectors with another length than ``dims`` or a null or non-finite component are left out; the others become
    integers, floor(scale * x). Centroids start as the ``k`` vectors of smallest hash (fewer vectors: as many as there
    are, so some clusters may never exist). Each of ``rounds`` rounds assigns all vectors and moves the centroids; a
    last assignment follows. Repeated rows count each for itself, a null id is kept and hashed as the empty text, and
    an empty table gives no rows. A component beyond 2**26 after scaling is an error, since distances would not
    fit a long. ``k`` and ``dims`` bound what the driver and the closures hold: k * dims integers.
    """
    vectors = saved(integer_vectors(rows, id_column, vector_column, dims, scale), "integer-vectors")
    centroids = first_centroids(vectors, k, salt)
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], shape)
    for _ in range(rounds):
        before, centroids = centroids, move(vectors, centroids).centroids
        if (before == centroids).all():  # nothing moves any more
            break
    last = saved(assigned(vectors, centroids), "assigned-vectors")
    discard(vectors)
    sums = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    numbers = range(len(centroids))
    return last.select(
        "vec_id", "cluster", "distance",
        of([sums.get(c, 0) for c in numbers], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.get(F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in c]) for c in centroids]), F.col("cluster")).alias("centroid"),
    )


def digests(clusters: DataFrame) -> DataFrame:
    """The centroid as the sha256 of its components, joined by commas."""
    text = F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string")))
    return clusters.withColumn("centroid_sha256", F.sha2(text, 256)).drop("centroid")
