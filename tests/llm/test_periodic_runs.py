import hashlib
import random
import zlib

import pytest

from aerolith.llm import periodic_runs as R, queries


def brute(words):
    """All runs by comparing every word with the one a period later, for every period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, size, q) for (s, size), q in out.items())


def collapsed(words, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = []
        while len(words) < rng.choice([0, 10, 30, 200, 900]):
            kind = rng.random()
            if kind < 0.4:
                words += [rng.choice("ab") for _ in range(rng.randint(1, 40))]
            elif kind < 0.7:
                block = [rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40, 70]))]
                words += (block * rng.randint(1, 30))[: rng.randint(1, 600)]
            else:
                words += [str(rng.randint(0, 1000)) for _ in range(rng.randint(1, 100))]
        out.append(words)
    return out


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_equals_brute_force(spark, make_docs, odd_rows):
    long = ["x", "y", "z"] * 7000 + [str(i) for i in range(500)] + [str(i) for i in range(4000)] * 4
    rows = odd_rows + [(100 + i, " ".join(w)) for i, w in enumerate(periodic_texts(2, 150))]
    rows += [(100, "a " * 24), (400, "a " * 23), (401, "a\t" * 25 + "é " * 30)]
    got = R.periodic_runs(make_docs(rows).repartition(4)).collect()
    seen = sorted((str(r["doc_id"]), r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got)
    want = []
    for i, t in rows:
        w = split(t)
        runs = brute(w) if len(w) < 20_000 else []  # the long text of odd_rows has no run
        want.append((str(i), len(w), tuple(runs), collapsed(w, runs)))
    assert seen == sorted(want)
    (only,) = R.periodic_runs(make_docs([(1, " ".join(long))])).collect()
    assert [tuple(x) for x in only["runs"]] == [(0, 21000, 3), (21500, 16000, 4000)]
    assert only["collapsed"] == collapsed(long, [(0, 21000, 3), (21500, 16000, 4000)])
    assert R.periodic_runs(make_docs([])).collect() == []


@pytest.mark.parametrize("low", [1, 2, 4, 8, 16, 64])
def test_boundaries_leave_no_run_out(low):
    o = R.Octave(low)
    assert o.spacing == min(map(R.least_matches, o.periods)) and o.reach == max(map(R.least_matches, o.periods))
    assert 0 < o.gram < o.spacing <= o.reach


def test_z_function():
    rng = random.Random(4)
    for _ in range(50):
        s = [rng.randint(0, 1) for _ in range(rng.randint(1, 40))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert R.z_function(s, 30) == want[:30]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in docs:
        words = planted(r["doc_id"], split(r["text"]))
        runs = brute(words) if len(words) < 6000 else None
        if runs is not None:
            best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
            shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            want[r["doc_id"]] = (len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)))
    got = {r["doc_id"]: tuple(r[1:]) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs) and {i: got[i] for i in want} == want
    assert sum(1 for v in want.values() if v[0]) >= 5
