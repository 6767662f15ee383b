"""Exact quantiles that do not gather a whole column in one task.

All columns and ranks share their passes over the input: one for approximate
percentiles that bracket every wanted rank, one that counts what lies below and
inside each bracket, and one that keeps the rows inside.  These few rows are
written; as long as a bracket holds more than ``small`` of them, the written rows
are narrowed in the same way.  The driver sees a few numbers per bracket.
"""

import math

from pyspark.sql import DataFrame, Window, functions as F

from aerolith.session import drop_dir, shared_dir, written

SMALL_ROWS = 200_000
ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY
_GRID = [i / 200 for i in range(201)]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    table = written(df, path)
    table.saved_path = path
    return table


class _Bracket:
    """Values of a column between ``lo`` and ``hi`` (None: no bound), and how many lie below."""

    def __init__(self, number: int, col: str, ranks: tuple[int, int]):
        self.number, self.col, self.ranks = number, col, ranks
        self.lo = self.hi = None
        self.below, self.inside = 0, None

    def holds(self, v):
        held = v.isNotNull()
        if self.lo is not None:
            held = held & (v >= self.lo)
        if self.hi is not None:
            held = held & (v <= self.hi)
        return held

    def under(self, v):
        return F.lit(False) if self.lo is None else v < self.lo


def _bounds(df: DataFrame, cols, probs):
    """Counts of all columns, and the edges of the brackets around all ranks, in one pass."""
    edges = [e for p in probs for e in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    row = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.percentile_approx(F.col(c).cast("double"), edges, ACCURACY).alias(f"e{i}") for i, c in enumerate(cols)],
    ).first()
    brackets = []
    for i, c in enumerate(cols):
        for k, p in enumerate(probs):
            if row[f"n{i}"]:
                place = p * (row[f"n{i}"] - 1)
                b = _Bracket(len(brackets), c, (math.floor(place), math.ceil(place)))
                b.lo, b.hi = row[f"e{i}"][2 * k : 2 * k + 2]
                brackets.append(b)
    return {c: row[f"n{i}"] for i, c in enumerate(cols)}, brackets


def _count(df: DataFrame, brackets, counts) -> None:
    """Rows below and inside every bracket in one pass; one that misses its ranks is opened to the whole column."""
    value = lambda b: F.col(b.col).cast("double")
    row = df.agg(
        *[F.count_if(b.under(value(b))).alias(f"u{b.number}") for b in brackets],
        *[F.count_if(b.holds(value(b))).alias(f"i{b.number}") for b in brackets],
    ).first()
    for b in brackets:
        b.below, b.inside = row[f"u{b.number}"], row[f"i{b.number}"]
        if b.ranks[0] < b.below or b.ranks[1] >= b.below + b.inside:
            b.lo = b.hi = None
            b.below, b.inside = 0, counts[b.col]


def _narrow(rows: DataFrame, brackets, small: int) -> DataFrame:
    """Written rows ``b, v, n`` cut down until every bracket has at most ``small`` distinct values."""
    while True:
        grid = {
            r["b"]: r
            for r in rows.groupBy("b").agg(F.count("*").alias("kinds"), F.percentile_approx("v", _GRID, ACCURACY).alias("g")).collect()
        }
        wide = [b for b in brackets if grid[b.number]["kinds"] > small]
        if not wide:
            return rows
        sums = {}
        for b in wide:  # what lies below each grid value, by one aggregate per bracket column
            for i, g in enumerate(grid[b.number]["g"]):
                sums[f"s{b.number}_{i}"] = F.sum(F.when((F.col("b") == b.number) & (F.col("v") < g), F.col("n")))
        got = rows.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in sums.items()]).first()
        keep = F.lit(False)
        for b in brackets:
            own = F.col("b") == b.number
            if b in wide:
                g = grid[b.number]["g"]
                below = [got[f"s{b.number}_{i}"] for i in range(len(g))]
                low = max(i for i in range(len(g)) if b.below + below[i] <= b.ranks[0])
                high = next((i for i in range(len(g)) if b.below + below[i] > b.ranks[1]), None)
                own = own & (F.col("v") >= g[low])
                if high is not None:
                    own = own & (F.col("v") < g[high])
                b.below += below[low]
            keep = keep | own
        before, rows = rows, _written(rows.filter(keep), "quantile-rows")
        drop_dir(rows.sparkSession, before.saved_path)


def exact_quantiles(df: DataFrame, cols, probs, small: int = SMALL_ROWS) -> dict[str, list]:
    """Linearly interpolated quantiles of each column, NULLs skipped; three passes over ``df``."""
    cols, probs = list(cols), list(probs)
    counts, brackets = _bounds(df, cols, probs)
    out = {c: [None] * len(probs) for c in cols}
    if not brackets:
        return out
    _count(df, brackets, counts)
    cells = F.array(
        *[
            F.when(b.holds(F.col(b.col).cast("double")), F.struct(F.lit(b.number).alias("b"), F.col(b.col).cast("double").alias("v")))
            for b in brackets
        ]
    )
    inside = df.select(F.inline(F.filter(cells, lambda x: x.isNotNull())))
    rows = _written(inside.groupBy("b", "v").agg(F.count("*").alias("n")), "quantile-rows")
    rows = _narrow(rows, brackets, small)
    # At most ``small`` distinct values of a bracket are left.
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = rows.withColumn("upto", upto)
    wanted = [F.min(F.when((F.col("b") == b.number) & (F.col("upto") > r - b.below), F.col("v"))) for b in brackets for r in b.ranks]
    values = summed.agg(*[w.alias(f"w{i}") for i, w in enumerate(wanted)]).first()
    drop_dir(rows.sparkSession, rows.saved_path)
    found = iter(range(len(wanted)))
    for c in cols:
        if counts[c]:
            for k, p in enumerate(probs):
                low, high = values[next(found)], values[next(found)]
                place = p * (counts[c] - 1)
                out[c][k] = low + (high - low) * (place - math.floor(place))
    return out
