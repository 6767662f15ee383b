"""SentencePiece encoding and decoding by weighted finite-state transducers and tropical shortest paths."""

import hashlib
import heapq
import re
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aerolith.llm.common import batch, documents

SPACE_MARK = "▁"
# Kinds of pieces and of models in the file format.
NORMAL, BYTE, UNIGRAM, BPE = 1, 6, 1, 2
# Chunks and pairs of pieces that a worker remembers at most.
CACHE, PAIRS = 500_000, 1_000_000
BYTES_WEIGHT = 100.0  # of a character without a piece in a unigram model: more than any piece


def _fields(data: bytes):
    """Number and value of each field of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Transducer:
    """Normaliser, pieces and byte fallback compiled from a model file; ``encode`` composes them with an input.

    The normaliser reads a character and writes it, or SPACE_MARK for a space, and writes one SPACE_MARK before a
    text. The piece transducer is a trie whose final arcs write an id; a character that no piece has goes through arcs
    that write its bytes. In a unigram model an arc weighs minus its score. In a BPE model scores rank merges and are
    no weights: there a state remembers its last piece, and an arc to a piece that merging would not leave beside it
    weighs infinity. Merging gives every prefix exactly one split of which all neighbours are compatible, so the only
    path of finite weight is the shortest one and equals the merges' result.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.names, self.scores, self.kinds = [], [], []
        self.model, normaliser = UNIGRAM, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only the identity normaliser with a leading space and escaped spaces is compiled")
        self.byte_ids = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == NORMAL}
        self.decoded = [
            bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE_MARK, " ").encode() if k == NORMAL else b""
            for n, k in zip(self.names, self.kinds)
        ]
        self.split: dict[int, tuple[int, int]] = {}
        if self.model == BPE:
            for name, i in list(self.ids.items()):
                if len(name) > 1 and not self._derive(name, i):
                    del self.ids[name]  # merging never makes it
        self.trie: dict = {}
        for name, i in self.ids.items():
            node = self.trie
            for c in name:
                node = node.setdefault(c, {})
            node[""] = i
        self._compatible: dict[tuple[int, int], bool] = {}
        self._remembered = _Remembered(self)
        # Where no piece has a mark after another character, texts can be cut before marks; likewise around line ends.
        inner = any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in self.ids)
        line = "" if any("\n" in n for n in self.ids) else "\n"
        self._cut = None if inner else re.compile(f"{line or '(?!)'}|{SPACE_MARK}*[^{SPACE_MARK}{line}]+|{SPACE_MARK}+")

    def merges(self, text: str) -> list[str]:
        """The pieces that merging leaves, best score first and leftmost among equals; used to compile compatibility."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i, j):
            if i >= 0 and j < len(parts) and (new := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[new], i, j, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] != j or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            self._last = (a, b)
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _derive(self, name: str, i: int) -> bool:
        if self.merges(name) != [name]:
            return False
        a, b = self._last
        if a not in self.ids or b not in self.ids:
            return False
        self.split[i] = (self.ids[a], self.ids[b])
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the two pieces side by side.

        Their last merges are undone, the worse one first; they stay apart unless what then meets would have merged
        before the merge that was undone (at equal scores the one further left comes first).
        """
        known = self._compatible.get((left, right))
        if known is None:
            if len(self._compatible) >= PAIRS:
                self._compatible.clear()
            known = self._compatible[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        names, scores, split = self.names, self.scores, self.split
        if SPACE_MARK * 2 in names[left] + names[right]:  # runs of marks share one score
            return self.merges(names[left] + names[right]) == [names[left], names[right]]
        limit, strict = float("-inf"), False
        while True:
            new = self.ids.get(names[left] + names[right])
            if new is not None and (scores[new] > limit or scores[new] == limit and not strict):
                return False
            a, b = split.get(left), split.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and scores[left] < scores[right]:
                limit, strict, left = scores[left], True, a[1]
            else:
                limit, strict, right = scores[right], False, b[0]

    def normalise(self, text: str) -> str:
        return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""

    def shortest_path(self, chunk: str) -> list[int]:
        """Ids of the shortest path through the composition of ``chunk`` with the piece transducer."""
        n = len(chunk)
        bpe = self.model == BPE
        # For each position: weight of the best path to it, its last piece (-1: bytes or none) and where that began.
        best: list = [None] * (n + 1)
        best[0] = (0.0, -1, 0)
        trie, scores, compatible = self.trie, self.scores, self.compatible
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            weight, last, _ = here
            node, j = trie.get(chunk[i]), i
            if node is None or "" not in node:  # no piece for the character: its bytes
                to = weight + (0.0 if bpe else BYTES_WEIGHT)
                if best[i + 1] is None or to < best[i + 1][0]:
                    best[i + 1] = (to, -1, i)
            while node is not None:
                j += 1
                piece = node.get("")
                if piece is not None and not (bpe and last >= 0 and not compatible(last, piece)):
                    to = weight if bpe else weight - scores[piece]
                    if best[j] is None or to < best[j][0]:
                        best[j] = (to, piece, i)
                node = node.get(chunk[j]) if j < n else None
        out, at = [], n
        while at:
            _, piece, start = best[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in reversed(chunk[start:at].encode())]
            at = start
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        chunks = self._cut.findall(text) if self._cut else [text] if text else []
        return np.frombuffer(b"".join(map(self._remembered.__getitem__, chunks)), "<u4")

    def decode(self, ids) -> str:
        """The inverse: the text of the pieces, without the space that the normaliser has put first."""
        text = b"".join(map(self.decoded.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


class _Remembered(dict):
    """Ids of chunks, as bytes; the same words come again and again."""

    def __init__(self, fst: Transducer):
        self.fst = fst

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.fst.shortest_path(chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string())]
)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs``; ``model`` is a file at the same path on every machine.

    Null and empty texts have no ids; repeated rows have the same; an empty table gives no rows.
    """

    def run(batches):
        fst = transducer(model)
        for b in batches:
            ids = [fst.encode(t).view("<i4") for t in b.column(1).to_pylist()]
            yield batch(_IDS, b.column(0), pa.array(ids, pa.list_(pa.int32())))

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        fst = transducer(model)
        for b in batches:
            yield batch(schema, b.column(0), pa.array([fst.decode(x or ()) for x in b.column(1).to_pylist()], pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_sha256``: digests of the ids and of what they decode to, in one pass."""

    def run(batches):
        fst = transducer(model)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                ids = fst.encode(t)
                out.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(fst.decode(ids).encode()).hexdigest()))
            if out:
                yield batch(_DIGEST, b.column(0), *map(pa.array, zip(*out)))

    return documents(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
