import hashlib
import math
import random

import numpy as np
import pytest

from aerolith.llm import centroid_clusters as C

ODD = "vec_id long, embedding array<float>, label int, v string, cluster int, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 7, "h") for i, e in rows], ODD)


def brute(rows, k, rounds, dims, scale=1024, salt="3"):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, _, v in sorted((name(i), -1 if i is None else i, v) for i, v in kept)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((gap(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        who = [n for _, n in assign()]
        for n in range(len(centroids)):
            mine = [v for w, (_, v) in zip(who, kept) if w == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    last = assign()
    inertia = lambda n: sum(d for d, m in last if m == n)
    return sorted(
        (str(i), n, d, inertia(n), sum(x for x, _ in last), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
        for (i, _), (d, n) in zip(kept, last)
    )


def result(df):
    return sorted(
        (str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
        for r in C.digests(df).collect()
    )


def test_equals_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(i % 5, 0.7))) for _ in range(6)]) for i in range(150)]
    rows += [(7, [0.0] * 6), (7, [0.0] * 6), (None, [0.5] * 6), (500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7)]
    rows += [(504, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (505, [math.nan] * 6), (506, [math.inf] + [0.0] * 5), (507, [-1e4] * 6)]
    got = result(C.centroid_clusters(table(spark, rows).repartition(3), k=8, rounds=4, dims=6))
    assert got == brute(rows, 8, 4, 6)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i), 1.0]) for i in range(n)]
    assert result(C.centroid_clusters(table(spark, rows), k=4, rounds=2, dims=2)) == brute(rows, 4, 2, 2)


def test_ties_and_copies(spark):
    """Centroids that are equal, and vectors as far from one as from another: the smaller number."""
    rows = [(i % 3, [float(i % 3) / 1024, 0.0]) for i in range(60)]
    assert result(C.centroid_clusters(table(spark, rows), k=4, rounds=3, dims=2)) == brute(rows, 4, 3, 2)


def test_walk_finds_the_nearest_and_stops_early():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-50, 50, (9, 7))
    centroids[4] = centroids[2]
    vectors = np.concatenate([rng.integers(-60, 60, (3000, 7)), centroids])
    number, distance = C.CentroidLists(centroids).nearest(vectors)
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        C.centroid_clusters(table(spark, [(1, [1e30, 0.0])]), dims=2).collect()
