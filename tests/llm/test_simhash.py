import random

import xxhash

from aerolith.llm import simhash as S
from aerolith.llm.graph import components
from tests.llm.conftest import rows_of


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, bits=2):
    """Smallest value that each value reaches over links of at most ``bits`` differing bits."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_equals_brute_force(spark, make_docs, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows = odd_rows + [(i + 100, t) for i, t in rows]
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    root = roots(f for _, f in fps)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = sorted(((i, f"{f:016x}", least[root[f]]) for i, f in fps), key=str)
    got = S.near_dedup(make_docs(rows))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == want


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(3)
    values = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(30):
            values.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) % 2**64)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    for bucket in (1, 4, 10_000):
        edges = S.links(spark.createDataFrame(signed, "fp long"), bucket).collect()
        parent = {v: v for v in values}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in edges:
            assert ((a ^ b) % 2**64).bit_count() <= 2
            x, y = sorted((find(a % 2**64), find(b % 2**64)))
            parent[y] = x
        assert {v: find(v) for v in values} == roots(values)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 999), (999, 1000), (5, 5), (2000, 300), (300, 2000)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {999: 999, 1000: 999, 300: 300, 2000: 300}


def test_empty(make_docs):
    assert S.near_dedup(make_docs([])).count() == 0
