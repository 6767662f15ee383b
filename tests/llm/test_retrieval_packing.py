import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolith.llm import retrieval_packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


def check(rows, packed, ids_of, length):
    """Every id of every row is in one piece, sequences have no gaps, and those not full are powers of two."""
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == length or (at < length and at & (at - 1) == 0)
    texts, pieces = defaultdict(list), defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in packed:
        pieces[r["doc_id"]].append(r)
    for i, found in texts.items():
        every = [np.array(ids_of(t), "<u4") for t in found]
        for ids in every:  # pieces that cover this text from its start to its end
            at, mine = 0, sorted((r for r in pieces[i] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
            while at < len(ids):
                fit = [r for r in mine if r["start"] == at and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]]
                assert fit, (i, at)
                pieces[i].remove(fit[0])
                mine.remove(fit[0])
                at += fit[0]["length"]
        assert not pieces[i]
    return by_sequence


def test_every_token_in_one_piece(make_docs, odd_rows, ids_of):
    rows = odd_rows + [(200 + i, "word " * (i * 37 % 400)) for i in range(200)] + [(900, "<|endoftext|> ß 中文 x'll 12")]
    packed = P.retrieval_pack(make_docs(rows).repartition(3), PATH, length=512, shard_docs=60).collect()
    check(rows, packed, ids_of, 512)
    assert P.retrieval_pack(make_docs([]), PATH).collect() == []


def test_ids_equal_those_of_the_file(spark, ids_of):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = [r[0] for r in rows] + ["İstanbul ΣΑΣ ﬁ", "á ́b", "<|startoftext|>x<|endoftext|>", " x　y\x85z", "it's WE'LL 3.14 a_b \x01\x00 ''s 'S x'"]
    known = P.tokens_of(PATH)
    assert known.pattern is not None
    for text in texts:
        assert np.frombuffer(known.encode(text), known.type).tolist() == ids_of(text)[:-1]


def test_tokenizers_that_keep_white_space_get_the_whole_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = P.Tokens(path)
    assert known.pattern is None
    want = Tokenizer.from_file(path).encode("a  b\n c", add_special_tokens=False).ids
    assert np.frombuffer(known.encode("a  b\n c"), known.type).tolist() == want


def bm25(query, docs, df, n, mean):
    out = []
    for d in docs:
        counts = Counter(d)
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in query}
        out.append(sum(idf[t] * counts[t] * 2.2 / (counts[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in query if t in counts))
    return out


@pytest.mark.parametrize("common", [0.0, 0.2, 1.1])
def test_scores_equal_brute_force(common):
    rng = random.Random(7)
    docs = [[int(rng.paretovariate(0.6)) % 300 for _ in range(rng.randint(1, 120))] for _ in range(90)]
    df = Counter(t for d in docs for t in set(d))
    frequency = np.array([df[t] for t in range(300)], float)
    total = sum(map(len, docs))
    index = P.Index([np.array(d, "<u2") for d in docs], P.Statistics(90, total, frequency), common)
    for d in range(0, 90, 7):
        want = bm25(set(docs[d]), docs, df, 90, total / 90)
        assert np.allclose(index.scores(index.terms[d]), want)


def test_statistics_cover_all_documents(make_docs, odd_rows, ids_of):
    table = P.tokens(make_docs(odd_rows).repartition(3), PATH)
    got = P.statistics(table, 49408)
    df = Counter(t for _, text in odd_rows for t in set(ids_of(text)))
    want = P.Statistics(len(odd_rows), sum(len(ids_of(t)) for _, t in odd_rows), np.array([df[t] for t in range(49408)], float))
    assert got.documents == want.documents and got.mean == want.mean and np.array_equal(got.idf, want.idf)


def test_windows_follow_the_ranking():
    """The seed's best neighbours that fit are in its window; the best that does not fit is cut."""
    kinds = {k: list(range(100 * k, 100 * k + 30)) for k in (1, 2, 3)}
    docs = [np.array((kinds[k] * 2)[: 40 + i], "<u2") for i in range(10) for k in (1, 2, 3)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400).astype(float)
    index = P.Index(docs, P.Statistics(len(docs), sum(map(len, docs)), df))
    for window in list(P.windows(docs, index, 128))[:3]:
        assert sum(n for _, _, n in window) == 128
        assert len({d % 3 for d, _, _ in window}) == 1


def test_alike_documents_share_windows(make_docs, ids_of):
    """Documents of one topic meet, in spite of shards."""
    rng = random.Random(2)
    topics = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40)] for _ in range(12)]
    rows = [(i, " ".join(rng.choices(topics[i % 12], k=60))) for i in range(600)]
    packed = P.retrieval_pack(make_docs(rows).repartition(3), PATH, length=2048, shard_docs=200).collect()
    same = total = 0
    for members in check(rows, packed, ids_of, 2048).values():
        kinds = Counter(r["doc_id"] % 12 for r in members)
        same += sum(n * n for n in kinds.values())
        total += len(members) ** 2
    assert same / total > 0.5  # by chance 0.08


def test_pieces_of_any_number_of_ids():
    """Short pieces are packed by prepared formats, longer ones by their own."""
    known = P.Tokens(PATH)
    for n in (1, 5, 63, 64, 65, 400):
        text = "".join(chr(0xE0 + 5 * i % 16) for i in range(n))
        want = known.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(known.encode(text), known.type).tolist() == want
