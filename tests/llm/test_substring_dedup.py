import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from aerolith.llm import substring_dedup as S
from tests.llm.conftest import rows_of

K = S.WINDOW


def brute(rows):
    split = [((t or "").encode().split(), i) for i, t in rows]
    seen = Counter(tuple(w[p : p + K]) for w, _ in split for p in range(len(w) - K + 1))
    out = []
    for w, i in split:
        covered = set()
        for p in range(len(w) - K + 1):
            if seen[tuple(w[p : p + K])] > 1:
                covered.update(range(p, p + K))
        kept = b" ".join(x for p, x in enumerate(w) if p not in covered)
        out.append((i, len(w), len(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_distance():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def planted():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 51, 80, 200)]
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            at = rng.randint(0, len(text))
            text[at:at] = p
        rows.append((i, rng.choice((" ", "  ", "\n")).join(text)))
    rows.append((500, " ".join(["same"] * 100)))
    rows.append((501, " ".join(passages[1] + ["x"] + passages[1])))
    return rows


def test_equals_brute_force(make_docs, odd_rows):
    rows = [(i, t if t is None else t[:6000]) for i, t in odd_rows] + planted()
    got = S.substring_dedup(make_docs(rows).repartition(5), digest=True)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == brute(rows)


def test_chunks_change_nothing(make_docs):
    rows = planted()
    docs = make_docs(rows).coalesce(1)
    got = S.substring_dedup(docs, digest=True, chunk_words=200)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == brute(rows)


@pytest.mark.parametrize("k", [1, 2, 15, 35])
def test_window_hashes(k):
    h = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    got = S.window_hashes(h, k, S.BASES[0])
    words = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
    assert len(got) == len(words) and len(set(zip(words, got.tolist()))) == len(set(words)) == len(set(got.tolist()))


def test_empty(make_docs):
    assert S.substring_dedup(make_docs([])).count() == 0
