"""Substring dedup by difference-cover anchors: a repeated passage shares an anchor with its other places."""

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import batch, documents

WINDOW = 35
# Every distance modulo PERIOD is a difference of two members of COVER. Hence for any two places of a window some
# offset below PERIOD falls on a cover position at both, and ANCHOR words from there lie inside the window.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_WORDS = 1_000_000
CACHE_WORDS = 500_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U64 = np.uint64


class _Hashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every ``k`` consecutive word hashes, by doubling."""
    n = len(h) - k + 1
    out, block, done, m = np.zeros(max(n, 0), _U64), h, 0, 1
    while m <= k and n > 0:
        power = _U64(pow(base, m, 2**64))
        if k & m:
            out = out * power + block[done : done + n]
            done += m
        block = block[:-m] * power + block[m:]
        m *= 2
    out ^= out >> _U64(29)
    return out * _U64(0xBF58476D1CE4E5B9)


class _Chunk:
    """Word hashes of some texts in a row, with the key of each text."""

    def __init__(self):
        self.keys, self.hashes, self.extra, self.words = [], [], [], 0

    def add(self, key: int, words: list[bytes], cache: _Hashes, extra=None) -> None:
        self.keys.append(key)
        self.hashes.append(np.fromiter(map(cache.__getitem__, words), _U64, len(words)))
        self.extra.append(extra)
        self.words += len(words)

    def layout(self):
        """All hashes, and of each word the number of its text, its place and the words from there to the end."""
        sizes = np.array([len(h) for h in self.hashes], np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.concatenate(self.hashes), text, place, sizes[text] - place


def _chunks(batches, columns: int, limit: int) -> Iterator[_Chunk]:
    """Texts with at least one window, in chunks of bounded size; a longer text is a chunk of its own."""
    cache, chunk = _Hashes(), _Chunk()
    for b in batches:
        extra = b.column(2) if columns > 2 else None
        for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            words = text.encode().split()
            if len(words) < WINDOW:
                continue
            chunk.add(key, words, cache, None if extra is None else extra[i].values.to_numpy())
            if chunk.words >= limit:
                yield chunk
                chunk = _Chunk()
    if chunk.words:
        yield chunk


_PLACES = [("key", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))]
_HASHED = pa.schema([("bucket", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int32())), *_PLACES])
_HASHED_SQL = "bucket int, high array<long>, low array<int>, key array<long>, pos array<int>"
_PLACED = pa.schema([("bucket", pa.int32()), *_PLACES])
_PLACED_SQL = "bucket int, key array<long>, pos array<int>"
_FOUND = pa.schema([("key", pa.int64()), ("pos", pa.list_(pa.int32()))])
_FOUND_SQL = "key long, pos array<int>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _equal_runs(high: np.ndarray, low: np.ndarray):
    """An order that puts equal hashes together, and for each place in it whether its predecessor is equal."""
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    same = np.zeros(len(order), bool)
    same[1:] = (h[1:] == h[:-1]) & (l[1:] == l[:-1])
    return order, same


def _sent(high, low, key, pos, buckets: int):
    """A chunk's places as rows for the shuffle.

    Of the places with equal hashes only one is sent to the task of that hash. If the chunk has more of them, all are
    known to repeat: they go to any task, to be passed on, and the one sent is a mark (-1) that tells the others.
    """
    order, same = _equal_runs(high, low)
    repeats = same.copy()
    repeats[:-1] |= same[1:]
    # In the order of the texts, so that keys stand in runs and compress.
    one = np.sort(order[~same])
    marked = np.zeros(len(order), bool)
    marked[order] = repeats
    place = np.where(marked[one], -1, pos[one]).astype(np.int32)
    to = (high[one] % _U64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    names, starts = np.unique(to[by], return_index=True)
    bounds = np.append(starts, len(by))
    one, place = one[by], place[by]
    if len(by):
        yield batch(
            _HASHED,
            pa.array(names, pa.int32()),
            _lists(high[one].view(np.int64), bounds, pa.int64()),
            _lists(low[one], bounds, pa.int32()),
            _lists(key[one], bounds, pa.int64()),
            _lists(place, bounds, pa.int32()),
        )
    known = order[repeats]
    if len(known):
        known = np.sort(known)
        ends = np.array([0, len(known)])
        none = np.array([0, 0])
        yield batch(
            _HASHED,
            pa.array([int(key[known[0]]) % buckets], pa.int32()),
            _lists(np.zeros(0, np.int64), none, pa.int64()),
            _lists(np.zeros(0, np.int32), none, pa.int32()),
            _lists(key[known], ends, pa.int64()),
            _lists(pos[known], ends, pa.int32()),
        )


def _repeated(buckets: int):
    """Places whose hash another place has, from the rows of one partition, as one row per bucket of keys."""

    def run(batches):
        high, low, key, pos = [], [], [], []
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b in batches:
            hashes, marks, keys, places = (c.flatten().to_numpy() for c in b.columns[1:])
            own = np.repeat(b.column(1).value_lengths().to_numpy() > 0, b.column(3).value_lengths().to_numpy())
            found[0].append(keys[~own])
            found[1].append(places[~own])
            for to, values in ((high, hashes), (low, marks), (key, keys[own]), (pos, places[own])):
                to.append(values)
        if high:
            high, low, key, pos = map(np.concatenate, (high, low, key, pos))
            order, same = _equal_runs(high, low)
            same[:-1] |= same[1:]
            known = order[same]
            known = known[pos[known] >= 0]
            found[0].append(key[known])
            found[1].append(pos[known])
        key, pos = map(np.concatenate, found)
        to = key.view(_U64) % _U64(buckets)
        order = np.lexsort((pos, key, to))
        names, starts = np.unique(to[order], return_index=True)
        bounds = np.append(starts, len(order))
        if len(names):
            yield batch(
                _PLACED,
                pa.array(names.astype(np.int32)),
                _lists(key[order], bounds, pa.int64()),
                _lists(pos[order], bounds, pa.int32()),
            )

    return run


def _gathered(batches):
    """One row for each key of a partition, with all its places."""
    key, pos = [], []
    for b in batches:
        key.append(b.column(1).flatten().to_numpy())
        pos.append(b.column(2).flatten().to_numpy())
    if key:
        key, pos = np.concatenate(key), np.concatenate(pos)
        order = np.lexsort((pos, key))
        names, starts = np.unique(key[order], return_index=True)
        yield batch(_FOUND, pa.array(names), _lists(pos[order], np.append(starts, len(order)), pa.int32()))


def _anchors(buckets: int, limit: int):
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches):
        for chunk in _chunks(batches, 2, limit):
            h, text, place, left = chunk.layout()
            hashes = window_hashes(h, ANCHOR, BASES[0])
            at = np.flatnonzero(cover[place % PERIOD] & (left >= ANCHOR))
            key = np.array(chunk.keys, np.int64)[text[at]]
            none = np.zeros(len(at), np.int32)
            yield from _sent(hashes[at], none, key, place[at].astype(np.int32), buckets)

    return run


def _windows(buckets: int, limit: int):
    """Around each repeated anchor, all windows that contain it."""

    def run(batches):
        for chunk in _chunks(batches, 3, limit):
            h, text, place, left = chunk.layout()
            near = np.zeros(len(h) + 1, np.int64)
            start = 0
            for n, anchors in zip(map(len, chunk.hashes), chunk.extra):
                np.add.at(near, start + np.maximum(anchors - (PERIOD - 1), 0), 1)
                np.add.at(near, start + np.minimum(anchors, n - WINDOW) + 1, -1)
                start += n
            at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (left >= WINDOW))
            high = window_hashes(h, WINDOW, BASES[0])[at]
            low = (window_hashes(h, WINDOW, BASES[1])[at] >> _U64(32)).astype(np.uint32).view(np.int32)
            key = np.array(chunk.keys, np.int64)[text[at]]
            yield from _sent(high, low, key, place[at].astype(np.int32), buckets)

    return run


def _places(hashed: DataFrame, buckets: int) -> DataFrame:
    """``key, pos``: all repeated places of each text that has some. Both shuffles carry blocks, not single places."""
    found = hashed.repartitionById(buckets, F.col("bucket")).mapInArrow(_repeated(buckets), _PLACED_SQL)
    return found.repartitionById(buckets, F.col("bucket")).mapInArrow(_gathered, _FOUND_SQL)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(digest: bool):
    def run(batches):
        for b in batches:
            out = []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2)):
                words = text.encode().split()
                kept = words
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = np.unique(starts.values.to_numpy())
                    edge[starts] += 1
                    np.add.at(edge, starts + WINDOW, -1)
                    kept = list(compress(words, np.cumsum(edge[:-1]) == 0))
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest() if digest else text.decode()))
            yield batch(_RESULT, b.column(0), *map(pa.array, zip(*out))) if out else batch(
                _RESULT, *(pa.array([], f.type) for f in _RESULT)
            )

    return run


def substring_dedup(docs: DataFrame, digest: bool = False, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row: the words that no repeated window covers, joined by a space.

    A window is 35 consecutive words of one text; it repeats if its words also start anywhere else, in the same text
    too. Anchors (15 words) are hashed at cover positions only. Where an anchor's hash is met twice, the match is
    extended: all windows that contain the anchor are compared by 96-bit hashes, and those met twice are removed.
    Places travel as lists, never as pairs; of equal hashes a chunk sends one on. With ``digest``, ``kept`` is its SHA-256.
    A text without a window (null, empty, short) keeps all words. Repeated rows repeat each other and lose all windows.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows are told apart by a hash of id and text: ids may repeat, and equal rows have equal places.
    keyed = documents(docs).select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    anchors = _places(keyed.select("key", "text").mapInArrow(_anchors(buckets, chunk_words), _HASHED_SQL), buckets)
    # With doc_id, which is not needed here, both joins read one and the same shuffle of the texts.
    near = keyed.join(anchors, "key").select("key", "text", "pos", "doc_id")
    repeats = _places(near.mapInArrow(_windows(buckets, chunk_words), _HASHED_SQL), buckets)
    return keyed.join(repeats, "key", "left").select("doc_id", "text", "pos").mapInArrow(
        _cut(digest), "doc_id long, n_words long, n_removed long, kept string"
    )
