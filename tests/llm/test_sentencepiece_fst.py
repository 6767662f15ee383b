import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from aerolith.llm import sentencepiece_fst as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return S.transducer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_texts_of_the_corpus(spark, both):
    fst, library = both
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t, want in zip(texts, library.encode(texts, num_threads=1)):
        ids = fst.encode(t)
        assert ids.tolist() == want and fst.decode(ids) == t


def test_odd_texts(both):
    fst, library = both
    rng = random.Random(2)
    pool = [*"aeinrstlo", " ", "  ", "   ", "\n", "\t", "the", "ing", "中", "文", "😀", "é", "▁", "0", "12", "<s>", "́", "ß", ".", ",", "'", "--", "==="]
    for _ in range(6000):
        t = "".join(rng.choices(pool, k=rng.randint(0, 25)))
        assert fst.encode(t).tolist() == library.encode(t), repr(t)
    for n in range(70):
        assert fst.encode(" " * n).tolist() == library.encode(" " * n)
        assert fst.encode("x" + " " * n + "y").tolist() == library.encode("x" + " " * n + "y")
    long = "".join(rng.choices("abcdeinorst", k=30_000))
    assert fst.encode(long).tolist() == library.encode(long)


def test_compatible_pieces_are_those_that_merging_leaves(both):
    fst, _ = both
    rng = random.Random(3)
    names = [n for n in fst.ids if n.isascii() or n[0] == S.SPACE_MARK]
    for _ in range(5000):
        a, b = rng.choice(names), rng.choice(names)
        assert fst.compatible(fst.ids[a], fst.ids[b]) == (fst.merges(a + b) == [a, b]), (a, b)


def test_operator(spark, make_docs, odd_rows, both):
    _, library = both
    docs = make_docs(odd_rows)
    want = sorted(((i, library.encode(t or "")) for i, t in odd_rows), key=str)
    encoded = S.encode(docs, PATH)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str) == want
    decoded = S.decode(encoded, PATH).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in decoded), key=str) == sorted(((i, t or "") for i, t in odd_rows), key=str)
    digests = sorted((tuple(r) for r in S.round_trip(docs, PATH).collect()), key=str)
    assert digests == sorted(
        ((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest())
         for (i, t), x in ((row, library.encode(row[1] or "")) for row in odd_rows)), key=str)
    assert S.encode(make_docs([]), PATH).count() == 0
