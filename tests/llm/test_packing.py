import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolith.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, packed, length):
    """Every id of every document is in one place, and sequences have no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id in {i for i, _ in rows}:
        want = []
        for text in [t for i, t in rows if i == doc_id]:
            ids = np.array(ids_of(text), "<u4")
            want += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(P.cuts(len(ids), length))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]) == sorted(want)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence)


def test_round_trip(make_docs, odd_rows):
    rows = odd_rows + [(200 + i, "word " * (i * 37 % 400)) for i in range(200)] + [(900, "<|endoftext|> ß 中文   x")]
    packed = P.pack(make_docs(rows), PATH, length=512, shard=60).collect()
    check(rows, packed, 512)


def test_cuts():
    assert P.cuts(5, 2) == [(0, 1), (1, 3), (3, 5)] and P.cuts(4, 2) == [(0, 2), (2, 4)] and P.cuts(1, 2) == [(0, 1)]


def test_ids_equal_those_of_the_file(spark):
    slow = Tokenizer.from_file(PATH)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    pool = [*map(chr, range(32, 0x250)), "\n", "\t", "\r", "'s", "  ", "'re", "12", "\x85", " ", "é", "中", "<|endoftext|>"]
    texts += ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        assert P.token_ids(t, PATH).tolist() == [*slow.encode(t, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("seed", range(3))
def test_evolution_keeps_pieces_and_is_no_worse(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(150, 1100, 400).tolist(), reverse=True)
    first = [P.first_solution(sizes, 2048, rng, x) for x in (0.0, 0.3, 0.3)]
    best = P.evolve(first, sizes, 2048, rng, 20, 6)[0][1]
    assert sorted(i for b in best for i in b) == list(range(400))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in best)
    assert -(-sum(sizes) // 2048) <= len(best) <= min(map(len, first))


def test_crossover_finds_the_perfect_packing():
    sizes = [6, 6, 5, 5, 5, 4, 4, 3, 2]
    rng = np.random.default_rng(0)
    population = [P.first_solution(sizes, 10, rng, x) for x in (0.0, 0.5, 0.5, 0.5)]
    assert len(P.evolve(population, sizes, 10, rng, 30, 6)[0][1]) == 4


def test_empty(make_docs):
    assert P.pack(make_docs([]), PATH).count() == 0
