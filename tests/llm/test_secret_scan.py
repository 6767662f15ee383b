import hashlib
import re
import time

import regex
from pyspark.sql import functions as F

from aerolith.llm import secret_scan as S


def h(x, n=40):
    return hashlib.sha256(str(x).encode()).hexdigest()[:n]


def texts():
    """(text, secrets): settings that the labelled findings do not have word by word."""
    out = []
    for i in range(40):
        k = h(i)
        out += [
            (f"Before it all.\nmy token = \"{k}\" and more", [k]),
            (f"set auth_token: '{k}' now", [k]),
            (f"aws AKIA{h(i, 16).upper()} used", [f"AKIA{h(i, 16).upper()}"]),
            (f"fixed in commit {k} yesterday", []),
            (f"checksum md5 {h(i, 32)} ok", []),
            (f"call {int(h(i), 16) % 10**16:016d} today", []),
            (f"go to https://site.org/news/2021-{i}-some-long-article-name today", []),
            (f"api_key = \"your-own-key-here-{i}\"", []),
        ]
    return out


def test_false_positives_are_removed(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(i, t, None) for i, (t, _) in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {i: s for i, (_, s) in enumerate(texts())}
    got = {r["doc_id"]: r for r in S.secret_scan(docs, S.labelled_findings(train)).collect()}
    right = 0
    for i, (text, _) in enumerate(texts()):
        found = [text[s["start"] : s["start"] + s["length"]] for s in got[i]["secrets"]]
        right += found == want[i]
        assert got[i]["text"] == re.sub("|".join(map(re.escape, found)), S.MASK, text) if found else got[i]["text"] == text
    assert right / len(want) > 0.95


def test_tokens_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = S.secret_scan(docs).join(docs.select("doc_id", F.col("text").alias("raw")), "doc_id").collect()
    assert len(got) == docs.count()
    pattern = re.compile(r'token = "([0-9a-fA-F]{40})"', re.I)
    for r in got:
        spans = {r["raw"][s["start"] : s["start"] + s["length"]] for s in r["secrets"]}
        assert set(pattern.findall(r["raw"])) == spans
        assert all(x not in r["text"] for x in spans)


def test_places_and_odd_rows(spark, make_docs, odd_rows):
    a, b = h(1), h(2)
    text = f"{a} é😀 {b}{'!'} {a}"
    rows = odd_rows + [(70, text), (71, a), (72, f"x{a}é{b}"), (70, text)]
    got = S.secret_scan(make_docs(rows), labelled=spark.createDataFrame([], "candidate string, before string, after string, path string, label double"))
    got = sorted(((r["doc_id"], r["text"], r["n_candidates"], [(s["start"], s["length"]) for s in r["secrets"]]) for r in got.collect()), key=str)
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), len(m.group())) for m in regex.finditer(S.CANDIDATE, t)]
        assert (i, regex.sub(S.CANDIDATE, S.MASK, t), len(spans), spans) in got
    assert len(got) == len(rows)
    assert S.secret_scan(make_docs([])).count() == 0


def shapes():
    """(text, secrets): lines of settings, addresses and prose, none of them worded as the labelled ones."""
    out = []
    for i in range(20):
        k, letters = h(i), h(i).translate(str.maketrans("0123456789", "ghijklmnop"))
        out += [
            (f"password: hunter{i % 10}abc", [f"hunter{i % 10}abc"]),
            (f'api_key = "{letters[:26]}"', [letters[:26]]),
            (f"DB_PASSWORD={k[:18]}\nDB_HOST=localhost\n", [k[:18]]),
            (f"GET https://host.net/v2/list?limit=5&api_key={k}&sort=asc", [k]),
            (f"secret_key={k[:20]}", [k[:20]]),
            (f"export APP_SECRET={h(i, 32)}", [h(i, 32)]),
            (f"my-access-key: '{h(i, 24)}',", [h(i, 24)]),
            ("Password: required to open the page", []),
            ("the secret: people should read more", []),
            (f"GET https://host.net/list?order_id={int(k, 16) % 10**18:018d}&page=1", []),
            (f"image sha256={h(i, 64)} pulled", []),
            ("password = \"changeme\"", []),
        ]
    return out


def test_recall_and_precision_on_held_out_shapes(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cases = shapes()
    docs = spark.createDataFrame([(i, t, None) for i, (t, _) in enumerate(cases)], "doc_id long, text string, source string")
    # The key is no part of what is found, and every secret is a candidate by itself.
    got = {r["doc_id"]: r for r in S.secret_scan(docs, S.labelled_findings(train)).collect()}
    hits, wrong, secrets = 0, 0, 0
    for i, (text, want) in enumerate(cases):
        found = [text[x["start"] : x["start"] + x["length"]] for x in got[i]["secrets"]]
        secrets += len(want)
        hits += len(set(found) & set(want))
        wrong += len(set(found) - set(want))
        for w in want:
            assert w in regex.findall(S.CANDIDATE, text)
    assert hits / secrets >= 0.95 and wrong <= 0.05 * hits


def test_made_secrets_are_found_as_they_are(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = S.made_texts(S.sample_of(docs, 50))
    found = S.candidates(made, "secret")
    missed = made.filter("secret is not null").join(found.filter("candidate = secret").select("key"), "key", "left_anti")
    assert missed.count() == 0


def test_very_many_candidates_in_a_text(spark, make_docs):
    texts = [" ".join(h(i, 20) + "0" for i in range(n)) for n in (63, 64, 65, 129, 100_000)]
    began = time.monotonic()
    found = S.candidates(S.with_keys(make_docs(list(enumerate(texts)))))
    assert found.count() == sum(t.count(" ") + 1 for t in texts)
    assert found.filter(F.col("start") != F.col("at") * 22).count() == 0
    assert time.monotonic() - began < 60


def test_frequent_words_are_those_of_all_rows(spark):
    """Counted over every row, not over the texts that labels are drawn from; rows that are repeated count once."""
    rows = [(i, "alpha beta" if i % 2 else "alpha", None) for i in range(2 * S.MAX_TEXTS)]
    rows += [(-i, "seldom", None) for i in range(1, 8)] + [(7000, "again", None)] * 20 + [(7001, "twice again", None)] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert S.frequent_words(docs) == ["alpha", "beta", "seldom"]
    assert S.frequent_words(docs, most=2) == ["alpha", "beta"]
    assert S.frequent_words(docs.limit(0)) == []
