import re

import numpy as np

from aerolith.llm import quality_rules as Q
from aerolith.llm.text_stats import repeat_words
from tests.llm.conftest import rows_of


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    found = {g for g in grams if grams.count(g) > 1} if len(words) < 2000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    if found is None:
        counts = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
        found = {g for g, n in counts.items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in found for k in range(3)}
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_equal_brute_force(spark, make_docs, odd_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = odd_rows + [(r[0] + 100, r[1]) for r in docs] + [(999, "a b c a b c a b c ### $"), (998, "x y z\x1cq é")]
    got = Q.quality_rules(make_docs(rows))
    assert rows_of(got, "doc_id", *COLUMNS) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert all(r["kept"] is False for r in got.collect() if r["base_failed"])


def test_many_distinct_words_in_windows():
    words = [str(i).encode() for i in range(50)] * 2 + [b"x"]
    assert repeat_words(words) == 100


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "good")
    rows = Q.quality_rules(docs).filter("not base_failed").join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == bool(r["good"]) for r in rows]) > 0.97
    assert np.mean([r["kept"] for r in rows if r["good"]]) > 0.99


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.85
    votes = np.stack([np.where(rng.random(len(good)) < 0.2, 0, np.where(good, rng.random(len(good)) < a, rng.random(len(good)) > b) * 2 - 1) for a, b in ((0.99, 0.9), (0.97, 0.8), (0.98, 0.7), (0.95, 0.85))], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    w = Q.fit(patterns.astype(float), counts.astype(float))
    assert abs(w.prior - 0.85) < 0.04 and np.abs(w.good - [0.99, 0.97, 0.98, 0.95]).max() < 0.04
    assert np.mean((w.posterior(votes) >= 0.5) == good) > 0.97


def test_empty(make_docs):
    assert Q.quality_rules(make_docs([])).count() == 0
