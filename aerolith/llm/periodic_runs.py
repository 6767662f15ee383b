"""Periodic runs of words, found in tiles of each period octave, and texts with the repeats of runs removed.

A run is a stretch of words with smallest period ``q`` that is at least ``max(LEAST, FOLD * q)`` long and that no
neighbouring word extends. At period ``q``, position ``i`` *matches* if the words ``i`` and ``i + q`` are equal: a run of
length ``n`` is a maximal stretch of ``n - q`` matches.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aerolith.llm.common import batch, saved

LEAST, FOLD = 24, 3
# Boundaries of a tile: more of them ship fewer words twice.
BOUNDARIES = 16
# Words numbered together before numbers start again.
CHUNK_WORDS = 200_000
# Words of tiles that a task solves.
TASK_WORDS = 500_000
_U64 = np.uint64
_MIX = _U64(0x9E3779B97F4A7C15)


def least_matches(period: int) -> int:
    """Matches of the shortest run of this period."""
    return max(LEAST, FOLD * period) - period


@dataclass(frozen=True)
class Octave:
    """Periods from ``low`` up to twice that.

    A run has a boundary in its stretch of matches if boundaries are as far apart as the shortest stretch of the
    octave is long. ``reach`` matches on each side of a boundary are looked at: as many as the longest of the shortest
    stretches, so that whatever ends inside that is known whole, and pieces of longer stretches overlap.
    """

    low: int

    @property
    def periods(self) -> range:
        return range(self.low, 2 * self.low)

    @property
    def spacing(self) -> int:
        return min(map(least_matches, self.periods)) if self.low < 16 else least_matches(self.low)

    @property
    def reach(self) -> int:
        return max(map(least_matches, self.periods)) if self.low < 16 else least_matches(2 * self.low - 1)

    @property
    def gram(self) -> int:
        """Words compared at once when candidates are looked for: half of the shortest stretch."""
        return self.spacing // 2

    @property
    def tile(self) -> int:
        """Positions from the first boundary of a tile to that of the next."""
        return self.spacing * BOUNDARIES

    def words_of(self, tile: int, n: int) -> tuple[int, int]:
        """The words of a text of ``n`` that a tile reads; tiles overlap by what boundaries look around."""
        first = tile * self.tile
        return max(0, first - self.reach), min(n, first + self.tile - self.spacing + self.reach + 2 * self.low)


def octaves(n: int) -> list[Octave]:
    """Those with a period that has a run in ``n`` words."""
    out, low = [], 1
    while max(LEAST, FOLD * low) <= n:
        out.append(Octave(low))
        low *= 2
    return out


def gram_hashes(numbers: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """A hash of every so many consecutive word numbers, for each size, by doubling."""
    out, powers = {}, {1: (numbers.astype(_U64) + _U64(1)) * _MIX}
    base = {1: 0xC2B2AE3D27D4EB4F}
    m = 1
    while 2 * m <= max(sizes, default=0):
        h = powers[m]
        powers[2 * m] = h[:-m] * _U64(base[m]) + h[m:] if len(h) > m else h[:0]
        base[2 * m] = base[m] * base[m] % 2**64
        m *= 2
    for size in sizes:
        m = 1 << (size.bit_length() - 1)
        h = powers[m]
        # Two overlapping blocks of a power of two cover the gram.
        n = len(numbers) - size + 1
        out[size] = h[:n] * _U64(0xFF51AFD7ED558CCD) + h[size - m : size - m + n] if n > 0 else h[:0]
    return out


def candidate_tiles(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, Octave, int]]:
    """``(text, octave, tile)`` of all tiles that may hold a run; texts lie in ``numbers`` one after another.

    Every stretch of matches as long as a run needs contains a gram that starts at a multiple of ``spacing - gram + 1``
    and is equal to the gram one period later. Equal words have equal hashes, so no run is missed.
    """
    longest = int((ends - starts).max(initial=0))
    found = octaves(longest)
    hashes = gram_hashes(numbers, sorted({o.gram for o in found}))
    out = set()
    for o in found:
        h, every = hashes[o.gram], o.spacing - o.gram + 1
        wide = np.flatnonzero(ends - starts >= max(LEAST, FOLD * o.low))
        # All starts of grams that are looked up: a grid over each text that is long enough for the octave.
        count = -(-(ends[wide] - starts[wide] - o.low) // every)
        text = np.repeat(wide, count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = starts[text] + at * every
        block = max(1, (1 << 20) // o.low)
        for i in range(0, len(at), block):
            a = at[i : i + block]
            inside = a < len(h) - 2 * o.low
            here, edge = a[inside], a[~inside]
            hits = np.empty(0, np.int64)  # starts of grams that come again a period later
            if len(here):
                after = np.lib.stride_tricks.sliding_window_view(h[o.low :], o.low)[here]
                hits = here[(after == h[here][:, None]).any(axis=1)]
            late = np.array([p for p in edge.tolist() if p < len(h) and (h[p + o.low : p + 2 * o.low] == h[p]).any()], np.int64)
            near = np.isin(a, np.append(hits, late))
            t, position = text[i : i + block][near], a[near] - starts[text[i : i + block][near]]
            # A stretch with this gram has a boundary at most a spacing before or after the gram's start.
            last = (ends[t] - starts[t] - 1) // o.spacing
            for boundary in (np.maximum(position // o.spacing - 1, 0), np.minimum(position // o.spacing + 1, last)):
                out.update((int(x), o.low, int(k)) for x, k in np.unique(np.column_stack([t, boundary // BOUNDARIES]), axis=0))
    return [(t, Octave(low), k) for t, low, k in sorted(out)]


def z_function(s: list[int], upto: int) -> list[int]:
    """For each start below ``upto``, how many elements are equal to those at the start of ``s``."""
    n = len(s)
    z = [0] * min(upto, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def boundary_stretches(words: list[int], at: int, octave: Octave) -> Iterator[tuple[int, int, int]]:
    """``(period, start, end)``: for each period the matches around the boundary ``at``, if they are as many as a run needs.

    One Z-function over the words from the boundary tells how far matches go on for every period at once, one over the
    reversed words before it how far they reach back.
    """
    lo, low, reach = max(0, at - octave.reach), octave.low, octave.reach
    ahead = words[at : at + reach + 2 * low]
    forward = z_function(ahead, 2 * low)
    back = words[lo:at][::-1]
    shifted = words[lo : at + 2 * low - 1][::-1]  # ends with the words before the boundary, one period later
    missing = at + 2 * low - 1 - (lo + len(shifted))  # words that the text does not have
    z = z_function([*back, -1, *shifted], len(back) + 1 + len(shifted))
    for q in octave.periods:
        if q >= len(ahead):
            break
        ahead_of = min(forward[q], reach)
        skip = 2 * low - 1 - q - missing  # of the shifted words, those beyond boundary + q
        behind = min(z[len(back) + 1 + skip], len(back)) if back and skip >= 0 else 0
        if ahead_of and ahead_of + behind >= least_matches(q):
            yield q, at - behind, at + ahead_of


def solve_tile(words: list[int], first: int, tile: int, octave: Octave) -> list[tuple[int, int, int]]:
    """``(period, start, end)`` of the stretches of matches that a tile knows, merged; ``first`` is the position of its
    first word in the text, positions returned are those in the text."""
    ends: dict[int, list[list[int]]] = {}
    for k in range(BOUNDARIES):
        at = tile * octave.tile + k * octave.spacing - first
        if at >= len(words):
            break
        for q, start, end in boundary_stretches(words, at, octave):
            known = ends.setdefault(q, [])
            if known and start <= known[-1][1]:
                known[-1][1] = max(known[-1][1], end)
                known[-1][0] = min(known[-1][0], start)
            else:
                known.append([start, end])
    return [(q, first + s, first + e) for q, pieces in ends.items() for s, e in pieces]


_FOUND = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()), ("collapsed", pa.string()),
        ("octave", pa.int32()), ("tile", pa.int64()), ("first", pa.int64()), ("words", pa.binary()),
    ]
)
_FOUND_SQL = (
    "row long, doc_id long, n_words long, text string, collapsed string, octave int, tile long, first long, words binary"
)


def _shown(text: bytes, digest: bool) -> str:
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _explode(digest: bool):
    """A row per text, without its tiles (``octave`` is null), and one per tile that may hold a run.

    Only texts with such a tile carry their words on; for the others the collapsed text is known at once.
    """

    def rows_of(chunk, numbers):
        lengths = np.array([len(w) for _, _, w in chunk], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        flat = np.concatenate([*numbers, np.empty(0, np.int64)]).astype(np.int64)
        tiles: dict[int, list] = {}
        for t, octave, k in candidate_tiles(flat, starts, ends):
            tiles.setdefault(t, []).append((octave, k))
        for t, (row, doc_id, words) in enumerate(chunk):
            joined = b" ".join(words)
            if t not in tiles:
                yield row, doc_id, len(words), None, _shown(joined, digest), None, None, None, None
                continue
            yield row, doc_id, len(words), joined.decode(), None, None, None, None, None
            mine = flat[starts[t] : ends[t]].astype("<i4")
            for octave, k in tiles[t]:
                a, b = octave.words_of(k, len(words))
                yield row, None, b - a, None, None, octave.low, k, a, mine[a:b].tobytes()

    def run(batches):
        for b in batches:
            chunk, numbers, number, held = [], [], {}, 0
            texts = b.column(2).cast(pa.binary())
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                words = (text.as_py() or b"").split()
                chunk.append((row, doc_id, words))
                numbers.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield from _batches(rows_of(chunk, numbers))
                    chunk, numbers, number, held = [], [], {}, 0
            yield from _batches(rows_of(chunk, numbers))

    return run


def _batches(rows, size: int = 2000, most: int = 1 << 24):
    """Arrow batches of bounded size."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[3] or "") + len(r[4] or "") + len(r[8] or b"")
        if len(out) >= size or held >= most:
            yield batch(_FOUND, *map(pa.array, zip(*out), _FOUND.types))
            out, held = [], 0
    if out:
        yield batch(_FOUND, *map(pa.array, zip(*out), _FOUND.types))


_PIECES = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _solve(batches):
    for b in batches:
        out = []
        for row, low, tile, first, words in zip(*(c.to_pylist() for c in b.columns)):
            numbers = np.frombuffer(words, "<i4").tolist()
            out += [(row, *piece) for piece in solve_tile(numbers, first, tile, Octave(low))]
        if out:
            yield batch(_PIECES, *map(pa.array, zip(*out), _PIECES.types))


def stitched(pieces: DataFrame) -> DataFrame:
    """``row, start, length, period`` of whole runs from the pieces ``row, period, s, e`` of their stretches of matches.

    Pieces of one row and period meet in one shuffle and are merged where they overlap or touch. Of equal intervals the
    smallest period is that of the run: an interval of three periods that has a smaller one as well has a divisor of it,
    and is just as maximal there.
    """
    at = Window.partitionBy("row", "period").orderBy("s", "e")
    before = F.max("e").over(at.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("s") > before)).cast("long")
    numbered = pieces.distinct().withColumn("new", new).withColumn("part", F.sum("new").over(at))
    whole = numbered.groupBy("row", "period", "part").agg(F.min("s").alias("start"), (F.max("e") - F.min("s") + F.col("period")).alias("length"))
    return whole.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


_RUN = "array<struct<start:long,length:long,period:long>>"


def _collapse(digest: bool):
    """Words of a text without those that lie in a run after its first period."""

    def run(batches):
        for b in batches:
            doc_id, n_words, runs, texts = b.columns
            out = []
            for text, mine in zip(texts.cast(pa.binary()), runs.to_pylist()):
                words = text.as_py().split()
                change = np.zeros(len(words) + 1, np.int64)
                for r in mine:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
                out.append(_shown(b" ".join([words[i] for i in kept]), digest))
            yield pa.RecordBatch.from_arrays(
                [doc_id, n_words, runs, pa.array(out, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    return run


def periodic_runs(docs: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``.

    ``runs`` lists ``start, length, period`` of all runs by start, then period; ``collapsed`` is the text without the words
    that lie in a run after its first period, joined by single spaces, or its sha256 with ``digest``.

    Each text is exploded into overlapping tiles per octave of periods; a tile in which no word sequence comes again a
    period of its octave later is not sent on. Tiles are solved each for itself, wherever the shuffle puts them, with
    Z-functions at their boundaries; what they find is shuffled by row and period and stitched. So a very long text is
    spread over many tasks, and only repeated stretches travel. Null and blank texts have no words and no runs; rows
    are told apart by their place, so repeated rows and ids give a row each; an empty table gives no rows.
    """
    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")
    )
    found = saved(given.mapInArrow(_explode(digest), _FOUND_SQL), "period-tiles")
    tiles = found.filter("octave is not null").select("row", "octave", "tile", "first", "words")
    # A given number, since tiles are few bytes and much work: small partitions must not be merged.
    words = found.filter("octave is not null").agg(F.sum("n_words")).first()[0] or 0
    dealt = tiles.repartition(1 + words // TASK_WORDS, F.xxhash64("row", "octave", "tile"))
    pieces = dealt.mapInArrow(_solve, "row long, period long, s long, e long")
    runs = saved(
        stitched(pieces).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs")),
        "period-runs",
    )
    texts = found.filter("octave is null")
    none = F.array().cast(_RUN)
    plain = texts.filter("text is null").select("doc_id", "n_words", none.alias("runs"), "collapsed")
    few = texts.filter("text is not null").join(runs, "row", "left").withColumn("runs", F.coalesce("runs", none))
    collapsed = few.select("doc_id", "n_words", "runs", "text").mapInArrow(
        _collapse(digest), f"doc_id long, n_words long, runs {_RUN}, collapsed string"
    )
    return plain.unionByName(collapsed)
