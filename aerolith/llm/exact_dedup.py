"""Exact dedup by Grace hashing: partitions spill and split until each fits an open-addressing table of whole texts."""

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import SPACE, batch, documents, join_by_hot_key, saved

Record = tuple[int, str, int | None, int]
FANOUT = 16
_HEAD = struct.Struct("<qqqI")
_NO_ID = 2**63 - 1


class ContentTable:
    """Distinct texts with the smallest id and the number of rows of each.

    Open addressing with linear probing: a slot holds the number of an entry, and a probe ends at an equal text (the
    whole text is compared, equal hashes are not enough) or at an empty slot.
    """

    def __init__(self):
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes, self.texts, self.least, self.counts = [], [], [], []
        self.size = 0

    def _slot(self, h: int, text: str | None) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if text is not None and self.hashes[entry] == h and self.texts[entry] == text:
                break
            at = (at + 1) & mask
        return at

    def add(self, record: Record, grow: bool = True) -> bool:
        """Count a record in; False if its text is new and the table may not grow."""
        h, text, least, count = record
        at = self._slot(h, text)
        entry = self.slots[at]
        if entry >= 0:
            self.least[entry] = min(self.least[entry], least)
            self.counts[entry] += count
            return True
        if not grow:
            return False
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.least.append(least)
        self.counts.append(count)
        self.size += 4 * len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            for i, h in enumerate(self.hashes):
                self.slots[self._slot(h, None)] = i
        return True

    def records(self) -> Iterator[Record]:
        return zip(self.hashes, self.texts, self.least, self.counts)


def _write(file, record: Record) -> None:
    h, text, least, count = record
    data = text.encode()
    file.write(_HEAD.pack(h, least, count, len(data)))
    file.write(data)


def _read(file) -> Iterator[Record]:
    file.seek(0)
    while head := file.read(_HEAD.size):
        h, least, count, n = _HEAD.unpack(head)
        yield h, file.read(n).decode(), least, count


def grace(records: Iterator[Record], budget: int, level: int = 1) -> Iterator[Record]:
    """Merge the records of equal texts in bounded memory.

    Once the table is full, texts that it lacks go to ``FANOUT`` spill files by a hash of their own for each level;
    each file is merged the same way. Every level takes up ``budget`` bytes of texts, so the recursion ends. The files
    are the scratch space of one task: they have no name and end with it.
    """
    table, files = ContentTable(), None
    for r in records:
        if not table.add(r, grow=table.size < budget):
            files = files or [tempfile.TemporaryFile() for _ in range(FANOUT)]
            _write(files[xxhash.xxh64_intdigest(r[1].encode(), level) % FANOUT], r)
    yield from table.records()
    del table
    for f in files or ():
        with f:
            yield from grace(_read(f), budget, level + 1)


_RECORDS = "h long, text string, least long, n long"
_ARROW = pa.schema([("h", pa.int64()), ("text", pa.string()), ("least", pa.int64()), ("n", pa.int64())])
_GROUPS = pa.schema([("text", pa.string()), ("least", pa.int64()), ("n", pa.int64())])


def _rows(batches) -> Iterator[Record]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _emit(records, schema, rows: int = 1024, size: int = 16 << 20):
    """Arrow batches of bounded size."""
    out, n = [], 0
    for r in records:
        out.append(r)
        n += len(r[0] if isinstance(r[0], str) else r[1])
        if len(out) >= rows or n >= size:
            yield batch(schema, *map(pa.array, zip(*out), schema.types))
            out, n = [], 0
    if out:
        yield batch(schema, *map(pa.array, zip(*out), schema.types))


def exact_groups(docs: DataFrame, budget: int = 128 << 20) -> DataFrame:
    """One row per text that several rows share: ``text_sha256``, ``keep_id``, ``group_size``.

    Each input partition merges its own copies first (a full table is sent on and emptied), so a text that fills a
    third of the corpus reaches its task as a few rows per input partition.
    """

    def combine(batches):
        table = ContentTable()
        for r in _rows(batches):
            if table.size >= budget:
                yield from _emit(table.records(), _ARROW)
                table = ContentTable()
            table.add(r)
        yield from _emit(table.records(), _ARROW)

    def merge(batches):
        yield from _emit(((t, i, n) for _, t, i, n in grace(_rows(batches), budget) if n > 1), _GROUPS)

    records = normalised(docs).select(
        F.xxhash64("text").alias("h"), "text", F.coalesce("doc_id", F.lit(_NO_ID)).alias("least"), F.lit(1).cast("long").alias("n")
    )
    merged = records.mapInArrow(combine, _RECORDS).repartition("h").mapInArrow(merge, "text string, least long, n long")
    return merged.select(
        F.sha2("text", 256).alias("text_sha256"),
        F.when(F.col("least") < _NO_ID, F.col("least")).alias("keep_id"),
        F.col("n").alias("group_size"),
    )


def normalised(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("text", F.regexp_replace("text", SPACE, " "))


def exact_dedup(docs: DataFrame, budget: int = 128 << 20) -> DataFrame:
    """Every row with the row of equal text that stays: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of white space has become one space; null is empty. Of equal texts
    the smallest ``doc_id`` stays; null ids come last. Rows repeated with their id count in ``group_size`` and are
    ``kept`` alike, being one document. An empty table gives an empty result; further columns are ignored.
    """
    ids = saved(normalised(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256")), "exact-ids")
    groups = saved(exact_groups(docs, budget), "exact-groups")
    copies = join_by_hot_key(ids, groups, "text_sha256", "group_size", ids.count())
    singles = ids.join(groups, "text_sha256", "left_anti").withColumns(
        {"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}
    )
    return copies.unionByName(singles).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
