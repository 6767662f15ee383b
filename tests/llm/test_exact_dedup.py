import hashlib
import re

from aerolith.llm import exact_dedup as E
from tests.llm.conftest import rows_of

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = min((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(make_docs, odd_rows):
    assert rows_of(E.exact_dedup(make_docs(odd_rows)), *COLUMNS) == brute(odd_rows)


def test_spills_and_splits(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"text {i % 40} " * (i % 7 + 1)) for i in range(400)]
    assert rows_of(E.exact_dedup(make_docs(rows).repartition(3), budget=1000), *COLUMNS) == brute(rows)


def test_equal_hashes_are_not_equal_texts():
    records = [(5, f"t{i % 10}", i, 1) for i in range(50)]
    for budget in (1 << 20, 300):
        merged = sorted((t, i, n) for _, t, i, n in E.grace(iter(records), budget))
        assert merged == [(f"t{k}", k, 5) for k in range(10)]


def test_table_grows():
    table = E.ContentTable()
    for i in range(5000):
        table.add((i * 64, str(i), i, 1))
    assert len(table.texts) == 5000 and not table.add((1, "new", 1, 1), grow=False)


def test_empty(make_docs):
    assert E.exact_dedup(make_docs([])).count() == 0


def test_hot_group(make_docs):
    rows = [(i, "copy" if i % 3 == 0 else f"own {i}") for i in range(300)]
    assert rows_of(E.exact_dedup(make_docs(rows)), *COLUMNS) == brute(rows)
