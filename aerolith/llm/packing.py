"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands."""

import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import batch, discard, documents, saved

LENGTH = 2048
END_ID = 0
# Pieces of a shard; every shard is packed on its own, so no task grows with the corpus.
SHARD = 8192
ISLANDS, ROUNDS, GENERATIONS, POPULATION, ELITES = 3, 2, 6, 5, 2
# Characters whose classes have long been fixed, so that both tokenizer libraries cut such texts alike.
_COMMON = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*")
SPECIAL = "<|endoftext|>"


@cache
def _tokenizers(path: str):
    """The tokenizer of the file; for texts of common characters a faster one with the same vocabulary, if there is one."""
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(path), None
    try:
        import base64

        import public_tokenizers
        import tiktoken

        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, FileNotFoundError):
        pass
    return slow, fast


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids without added special tokens, then END_ID."""
    slow, fast = _tokenizers(path)
    if fast is not None and _COMMON.fullmatch(text) and SPECIAL not in text:
        ids = fast.encode_to_numpy(text, disallowed_special=())
    else:
        ids = slow.encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END_ID
    return out


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and end of each piece; only the first may be shorter than ``length``."""
    ends = list(range(n, 0, -length))[::-1]
    return list(zip([0, *ends[:-1]], ends))


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """A row per piece of every row of ``docs``."""

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = token_ids(text, tokenizer)
                out += [(doc_id, i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(cuts(len(ids), length))]
            if out:
                yield batch(_PIECES, *map(pa.array, zip(*out), _PIECES.types))

    return documents(docs).mapInArrow(run, _PIECES_SQL)


class Packing:
    """Bins of pieces that can be changed: pieces by bin, and the bins with each amount of room."""

    def __init__(self, sizes: np.ndarray, length: int):
        self.sizes, self.length = sizes, length
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.by_room: list[list[int]] = [[] for _ in range(length + 1)]
        self.mask = 0  # bit r: some bin may have room r
        self.next = 0

    def _list(self, b: int, room: int) -> None:
        self.room[b] = room
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def open(self, items: list[int], room: int) -> None:
        self.bins[self.next] = items
        self._list(self.next, room)
        self.next += 1

    def close(self, b: int) -> list[int]:
        del self.room[b]
        return self.bins.pop(b)

    def best_fit(self, items) -> None:
        """Put each piece, longest first, where it leaves least room; open a bin where it fits nowhere."""
        sizes, by_room, room_of = self.sizes, self.by_room, self.room
        for i in sorted(items, key=sizes.__getitem__, reverse=True):
            size = sizes[i]
            while above := self.mask >> size:
                room = size + (above & -above).bit_length() - 1
                listed = by_room[room]
                while listed and room_of.get(listed[-1]) != room:
                    listed.pop()  # closed meanwhile, or its room has changed
                if listed:
                    b = listed.pop()
                    self.bins[b].append(i)
                    self._list(b, room - size)
                    break
                self.mask &= ~(1 << room)
            else:
                self.open([i], self.length - size)


Solution = list[list[int]]


def fitness(solution: Solution, sizes: list[int], length: int) -> tuple[int, float]:
    """Fewer bins first; among as many, those with fuller bins, as uneven as can be."""
    fills = np.array([sum(map(sizes.__getitem__, b)) for b in solution]) / length
    return -len(solution), float((fills**2).sum() / max(1, len(solution)))


def _load(solution: Solution, sizes, length, without=()) -> Packing:
    p = Packing(sizes, length)
    for k, b in enumerate(solution):
        if k not in without:
            p.open(list(b), length - sum(map(sizes.__getitem__, b)))
    return p


def first_solution(sizes: list[int], length: int, rng: np.random.Generator, noise: float) -> Solution:
    """Best fit by falling size; ``noise`` leaves out a part of the pieces at first."""
    p = Packing(sizes, length)
    late = rng.random(len(sizes)) < noise
    p.best_fit(np.flatnonzero(~late).tolist())
    p.best_fit(np.flatnonzero(late).tolist())
    return list(p.bins.values())


def crossover(a: Solution, b: Solution, sizes: list[int], length: int, rng: np.random.Generator) -> Solution:
    """Inject well-filled bins of ``b`` into ``a``: bins of ``a`` with any of their pieces go, what they lose is refitted.

    A few of the emptiest bins of ``a`` are dissolved as well, which is the mutation.
    """
    full = [k for k, x in enumerate(b) if sum(map(sizes.__getitem__, x)) >= 0.995 * length]
    take = {k for k in full if rng.random() < 0.1}
    injected = [b[k] for k in take]
    new = {i for x in injected for i in x}
    hit = {k for k, x in enumerate(a) if not new.isdisjoint(x)}
    fills = [sum(map(sizes.__getitem__, x)) for x in a]
    poor = sorted((f, k) for k, f in enumerate(fills) if k not in hit)[: 2 + int(rng.integers(0, 6))]
    gone = hit | {k for _, k in poor}
    p = _load(a, sizes, length, gone)
    for x in injected:
        p.open(list(x), length - sum(map(sizes.__getitem__, x)))
    p.best_fit([i for k in gone for i in a[k] if i not in new])
    return list(p.bins.values())


def evolve(population: list[Solution], sizes: list[int], length: int, rng: np.random.Generator, generations: int, size: int):
    """The best ``size`` solutions after some generations; the best one so far always survives."""
    least = -(-sum(sizes) // length)
    scored = sorted(((fitness(s, sizes, length), s) for s in population), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(scored[0][1]) <= least:
            break
        children = []
        for _ in range(size):
            i, j = rng.integers(0, len(scored), 2)
            a, b = scored[min(i, j)][1], scored[rng.integers(0, len(scored))][1]
            child = crossover(a, b, sizes, length, rng)
            children.append((fitness(child, sizes, length), child))
        scored = sorted(scored + children, key=lambda x: x[0], reverse=True)[:size]
    return scored


def _genome(solution: Solution, n: int) -> bytes:
    out = np.empty(n, np.int32)
    for k, b in enumerate(solution):
        out[b] = k
    return out.tobytes()


def _solution(genome: bytes) -> Solution:
    bins = np.frombuffer(genome, np.int32)
    order = np.argsort(bins, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)] if len(bins) else []


_STATE = "shard long, island int, bins long, fill double, genome binary, sizes binary"
_ORDER = ["length", "doc_id", "piece", "ids_crc32"]


def _seed(length: int, islands: int, population: int):
    """First populations: a shard's pieces, longest first, packed by each island in ways of its own."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(rows["length"].to_numpy())[::-1]
        sizes, shard, out = lengths.tolist(), int(key[0]), []
        for island in range(islands):
            rng = np.random.default_rng([abs(shard), island])
            for k in range(population):
                noise = 0.0 if island == 0 and k == 0 else float(rng.uniform(0, 0.5))
                s = first_solution(sizes, length, rng, noise)
                bins, fill = fitness(s, sizes, length)
                out.append((shard, island, -bins, fill, _genome(s, len(sizes)), lengths.astype("<u2").tobytes()))
        return pd.DataFrame(out, columns=["shard", "island", "bins", "fill", "genome", "sizes"])

    return run


def _island(length: int, islands: int, population: int, generations: int, elites: int, step: int):
    """Evolve one island of one shard; its elites also go to the next island."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        rng = np.random.default_rng([abs(shard), island, step])
        sizes = np.frombuffer(rows["sizes"].iloc[0], "<u2").astype(int).tolist()
        rows = rows.sort_values(["bins", "fill", "genome"], ascending=[True, False, True])
        scored = evolve([_solution(g) for g in rows["genome"]], sizes, length, rng, generations, population)
        out = []
        for k, ((bins, fill), s) in enumerate(scored):
            genome = _genome(s, len(sizes))
            for to in {island, (island + 1) % islands} if k < elites else {island}:
                out.append((shard, to, -bins, fill, genome, rows["sizes"].iloc[0]))
        return pd.DataFrame(out, columns=["shard", "island", "bins", "fill", "genome", "sizes"])

    return run


_PACKED_SQL = f"{_PIECES_SQL}, sequence_id long, offset long"


def _place(key: tuple, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    """Sequence and offset of every piece of a shard under its best solution."""
    rows = rows.sort_values(_ORDER, ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    bins = np.frombuffer(best["genome"].iloc[0], np.int32).astype(np.int64)
    rows["sequence_id"] = int(key[0]) * 2**32 + bins
    rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    return rows.drop(columns="shard")


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    shard: int = SHARD,
    islands: int = ISLANDS,
    rounds: int = ROUNDS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    elites: int = ELITES,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: a row per piece of every row of ``docs``.

    A document is its token ids and END_ID; only longer ones than ``length`` are cut. A full piece is a sequence.
    The others are dealt by hash to shards of about ``shard`` pieces. Each shard has islands whose populations of
    packings evolve apart: crossover injects well-filled bins of one parent into the other, drops the pieces found
    twice and best-fits those displaced; after each round elites move to the next island. Populations are written
    between rounds. The first member of a shard is best fit by falling size, so no result is worse than that.
    Null and empty texts are one piece with END_ID alone; repeated rows are packed each for itself; an empty table gives no
    rows. Tokenizers are the file at ``tokenizer``, the same path on every machine.
    """
    if not 0 < length < 2**16:
        raise ValueError("length must be between 1 and 65535")
    cut = saved(pieces(docs, tokenizer, length), "pieces")
    full = cut.filter(F.col("length") == length)
    rest = cut.filter(F.col("length") < length)
    shards = max(1, -(-rest.count() // shard))
    # A shard must hold the same rows each time it is computed: the hash is over the row itself.
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    state = saved(dealt.select("shard", "length").groupBy("shard").applyInPandas(_seed(length, islands, population), _STATE), "islands")
    for step in range(rounds):
        evolved = state.groupBy("shard", "island").applyInPandas(
            _island(length, islands, population, generations, elites, step), _STATE
        )
        before, state = state, saved(evolved, "islands")
        discard(before)
    best = state.groupBy("shard").agg(F.min_by("genome", F.struct("bins", -F.col("fill"), "island", "genome")).alias("genome"))
    packed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_place, _PACKED_SQL)
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
