"""Packing by lexical retrieval: documents that a BM25 index finds for a seed document share its window."""

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import batch, saved

LENGTH = 4096
END_ID = 2
# A shard of the index: so many documents and tokens at most, whatever the corpus holds.
SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
# Saturation of repeated terms and weight of the document length in BM25.
K1, B = 1.2, 0.75
# Terms in more than this share of a shard's documents are kept as whole rows of weights instead of postings.
COMMON = 0.2
CACHE_PIECES = 400_000
# Characters up to this one are common.
LAST = 0x24F
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


class _Remembered(dict):
    """Values of ``find``, remembered up to a number of them."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, key):
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[key] = value = self.find(key)
        return value


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printed in Latin-1, and
    characters from U+0100 on, in order, for the other bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(hidden)}


class Tokens:
    """Ids of texts under a tokenizer file, as the bytes of little-endian numbers.

    A file that drops white space, lowers case and cuts by one pattern is followed piece by piece: known pieces are
    remembered, new ones go to the file's merges alone. Words with rare characters, and texts under any other file, are
    given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.type = np.dtype("<u2" if self.vocabulary <= 2**16 else "<u4")
        self.pattern = _piece_pattern(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # White space and Latin characters: none is changed by NFC, and all libraries class and lower them alike.
        self.common = re.compile(f"[\t\n\r{chr(0x20)}-\x7e\xa1-{chr(LAST)}]*")
        self.special = re.compile("|".join(special) or "(?!)")
        self.pieces = _Remembered(self._piece)
        self.tokenize = self.tokenizer.model.tokenize  # asked for by piece, so not looked up each time
        self.packs = [struct.Struct(f"<{n}{'H' if self.type.itemsize == 2 else 'I'}").pack for n in range(64)]
        self.characters = _byte_characters()

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) < len(self.packs):
            return self.packs[len(ids)](*ids)
        return struct.pack(f"<{len(ids)}{'H' if self.type.itemsize == 2 else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.characters)
        return self._bytes([t.id for t in self.tokenize(mapped)])

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        if self.pattern is not None:
            special = self.special.search(text)
            if not special and self.common.fullmatch(text):
                return self._cut(text)
            if not special:  # no piece reaches over white space
                return b"".join([self._cut(w) if self.common.fullmatch(w) else self._whole(w) for w in _SPACES.split(text)])
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _piece_pattern(path: str):
    """The pattern that cuts pieces out of common characters, if that and dropping white space and case is all that the
    file does to a text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if (spec["normalizer"] or {}).get("normalizers") != normal or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    cut, mapped = steps
    plain = cut["behavior"] == "Removed" and cut["invert"] and not mapped["add_prefix_space"] and not mapped["use_regex"]
    pattern = cut["pattern"].get("Regex")
    if not (plain and pattern and spec["model"]["type"] == "BPE"):
        return None
    for kind in "LN":  # classes that Python's patterns do not have
        members = "".join(c for c in map(chr, range(LAST + 1)) if unicodedata.category(c)[0] == kind)
        pattern = pattern.replace(rf"\p{{{kind}}}", members)
    return re.compile(pattern) if "\\p" not in pattern else None


@cache
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


_TOKENS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
    + [("k1", pa.int32()), ("k2", pa.int32()), ("term", pa.int32())]
)


def clocks(vocabulary: int, seed: int) -> np.ndarray:
    """Per term a waiting time, shorter for rarer terms. The term of a document with the shortest time is the same for
    two documents with the chance of their weighted overlap, so that it brings alike ones into one shard.

    Merges are numbered by how frequent they are, so the number of a term stands for how rare it is.
    """
    chance = np.random.default_rng(seed).random(vocabulary)
    return -np.log(1 - chance) / np.log(2.0 + np.arange(vocabulary))


def tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``row, doc_id, n, ids, k1, k2`` of every row: its token ids and ``end_id``, two bytes an id where the vocabulary
    allows, and two terms drawn by ``clocks``. Rows with a ``term`` instead say that ``n`` texts of a task have it."""

    def run(batches):
        known = tokens_of(tokenizer)
        size = max(known.vocabulary, end_id + 1)
        end, times, df = np.array([end_id], known.type).tobytes(), [clocks(size, 1), clocks(size, 2)], np.zeros(size, np.int64)
        for b in batches:
            ids = [known.encode(t) + end for t in b.column(2).to_pylist()]
            arrays = [np.frombuffer(x, known.type) for x in ids]
            met = [term_counts(x)[0] for x in arrays]
            for x in met:
                df[x] += 1
            keys = [pa.array([int(x[np.argmin(t[x])]) for x in met], pa.int32()) for t in times]
            yield batch(_TOKENS, b.column(0), b.column(1), list(map(len, arrays)), pa.array(ids, pa.binary()), *keys, pa.nulls(len(ids), pa.int32()))
        met = np.flatnonzero(df)
        none = lambda kind: pa.nulls(len(met), kind)
        yield batch(_TOKENS, none(pa.int64()), none(pa.int64()), df[met], none(pa.binary()), none(pa.int32()), none(pa.int32()), met.astype(np.int32))

    given = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return given.mapInArrow(run, "row long, doc_id long, n long, ids binary, k1 int, k2 int, term int")


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document, sorted, and how often each occurs."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[first], np.diff(first, append=len(ids))


class Statistics:
    """Corpus counts for BM25: documents, their mean length, and for each term the documents that have it.

    Terms are token ids, so the table has as many entries as the vocabulary, whatever the corpus is.
    """

    def __init__(self, documents: int, tokens: int, frequency: np.ndarray):
        self.documents = documents
        self.mean = tokens / max(1, documents)
        self.idf = np.log(1 + (documents - frequency + 0.5) / (frequency + 0.5))

    def weights(self, terms: np.ndarray, counts: np.ndarray, length) -> np.ndarray:
        """What a term of a document adds to the document's score for a query with that term."""
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean))


def statistics(table: DataFrame, vocabulary: int) -> Statistics:
    """Over all documents of a table of ``tokens``."""
    counted = table.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = np.zeros(vocabulary)
    for r in counted.collect():  # one row per id of the vocabulary at most
        frequency[r["term"]] = r["n"]
    total = table.filter("term is null").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return Statistics(total["documents"], total["tokens"], frequency)


class Index:
    """Inverted BM25 index of one shard."""

    def __init__(self, docs: list[np.ndarray], statistics: Statistics, common: float = COMMON):
        self.terms, counts = zip(*map(term_counts, docs))
        sizes = np.array([len(t) for t in self.terms])
        lengths = np.repeat([len(d) for d in docs], sizes)
        terms = np.concatenate(self.terms).astype(np.int64)
        weights = statistics.weights(terms, np.concatenate(counts), lengths)
        owner = np.repeat(np.arange(len(docs)), sizes)
        order = np.argsort(terms, kind="stable")
        self.doc, self.weight = owner[order], weights[order]
        met, start, size = np.unique(terms[order], return_index=True, return_counts=True)
        self.place = np.full(len(statistics.idf), -1)  # number of a term in this shard
        self.place[met] = np.arange(len(met))
        self.start, self.end = start, start + size
        rows = np.flatnonzero(size > max(common * len(docs), 8))
        self.row = np.full(len(met), -1)
        self.row[rows] = np.arange(len(rows))
        self.common = np.zeros((len(rows), len(docs)), np.float64)
        for i, k in enumerate(rows):
            self.common[i, self.doc[self.start[k] : self.end[k]]] = self.weight[self.start[k] : self.end[k]]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 score of every document of the shard for the distinct terms ``query``."""
        at = self.place[query]
        at = at[at >= 0]
        row = self.row[at]
        out = self.common[row[row >= 0]].sum(axis=0)
        rare = at[row < 0]
        if len(rare):
            size = self.end[rare] - self.start[rare]
            every = np.arange(size.sum()) + np.repeat(self.start[rare] - (np.cumsum(size) - size), size)
            out += np.bincount(self.doc[every], self.weight[every], minlength=len(out))
        return out


Piece = tuple[int, int, int]  # document of the shard, start, length


def windows(docs: list[np.ndarray], index: Index, length: int = LENGTH) -> Iterator[list[Piece]]:
    """Windows of exactly ``length`` tokens that together hold every token once; only the last one may be shorter.

    A seed, the rest of a cut document or else the first unused one, opens a window. The index ranks the unused
    documents for it. Those that fit are taken in that order; the best of the others is cut to fill what room is left,
    and its rest is the next seed. Documents without a common term rank last, in their order.
    """
    sizes = np.array([len(d) for d in docs])
    unused = np.ones(len(docs), bool)
    seed, start, first = 0, 0, 0
    unused[:1] = False
    while seed is not None:
        size = min(length, int(sizes[seed]) - start)
        window, room = [(seed, start, size)], length - size
        if start + size < sizes[seed]:
            start += size
            yield window
            continue
        seed, start = None, 0
        left = np.flatnonzero(unused)
        if room and len(left):
            scores = index.scores(index.terms[window[0][0]])[left]
            ranked = left[np.argsort(-scores, kind="stable")]
            ranked_sizes = sizes[ranked]
            while room:
                fits = np.flatnonzero((ranked_sizes <= room) & unused[ranked])
                if not len(fits):
                    break
                # All that fit one after another from the first on are taken at once.
                together = np.cumsum(ranked_sizes[fits])
                take = fits[: max(1, int(np.searchsorted(together, room, side="right")))]
                for d in ranked[take].tolist():
                    window.append((d, 0, int(sizes[d])))
                    unused[d] = False
                room -= int(ranked_sizes[take].sum())
            rest = ranked[unused[ranked]]
            if room and len(rest):
                seed, start = int(rest[0]), room
                window.append((seed, 0, room))
                unused[seed] = False
        if seed is None:
            while first < len(docs) and not unused[first]:
                first += 1
            if first < len(docs):
                seed = first
                unused[seed] = False
        yield window


def without_padding(window: list[Piece], length: int = LENGTH) -> Iterator[list[Piece]]:
    """A window that is not full, cut into windows whose lengths are powers of two, which need no padding."""
    total = sum(n for _, _, n in window)
    if total == length:
        yield window
        return
    rest = list(reversed(window))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            doc, start, n = rest.pop()
            now = min(n, room)
            part.append((doc, start, now))
            room -= now
            if now < n:
                rest.append((doc, start + now, n - now))
        yield part


_PACKED = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
_PACKED_SQL = ", ".join(f"{c} long" for c in _PACKED.names)


def _shards(batches, kind: np.dtype, most_docs: int, most_tokens: int):
    """The documents of a partition in shards of bounded size."""
    ids, docs, held = [], [], 0
    for b in batches:
        for doc_id, x in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(x.as_buffer(), kind)
            if docs and (len(docs) >= most_docs or held + len(x) > most_tokens):
                yield ids, docs
                ids, docs, held = [], [], 0
            ids.append(doc_id)
            docs.append(x)
            held += len(x)
    if docs:
        yield ids, docs


def retrieval_pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    shard_docs: int = SHARD_DOCS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a row per piece of every row of ``docs``.

    A document is its token ids and ``end_id``. Corpus statistics for BM25 are counted over all documents. Documents
    are ordered by a term drawn by weight, so that alike ones are likely to be neighbours, and this order is cut into
    shards of bounded size: a hot term or group of copies is spread over many. Each shard has an inverted index that
    returns unused neighbours for a seed, which fill its window. All windows have ``length`` tokens, but for the last
    one of a shard, which is cut into powers of two. Null and empty texts are ``end_id`` alone, repeated rows are packed
    each for itself, a text longer than a window fills windows of its own until its rest is a seed, and an empty table
    gives no rows. The tokenizer is the file at ``tokenizer``, the same path on every machine.
    """
    known = tokens_of(tokenizer)
    vocabulary, kind = max(known.vocabulary, end_id + 1), known.type
    table = saved(tokens(docs, tokenizer, end_id), "packing-tokens")
    corpus = statistics(table, vocabulary)

    def fill(batches):
        number = TaskContext.get().partitionId() << 40
        for ids, texts in _shards(batches, kind, shard_docs, shard_tokens):
            out, index = [], Index(texts, corpus)
            for window in windows(texts, index, length):
                for part in without_padding(window, length):
                    offset = 0
                    for d, start, n in part:
                        crc = zlib.crc32(texts[d][start : start + n].astype("<u4").tobytes())
                        out.append((ids[d], start, n, crc, len(texts[d]), number, offset))
                        offset += n
                    number += 1
            yield batch(_PACKED, *map(pa.array, zip(*out), _PACKED.types))

    tokens_in_all = corpus.mean * corpus.documents
    shards = 1 + int(max(corpus.documents / shard_docs, tokens_in_all / shard_tokens))
    order = ["k1", "k2", "row"]
    documents = table.filter("term is null").select("doc_id", "ids", *order)
    dealt = documents.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return dealt.mapInArrow(fill, _PACKED_SQL)
