"""Small learning helpers for classifiers that are fitted on bounded samples."""

import numpy as np
from pyspark.sql import DataFrame, functions as F


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept first, by Newton's method with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * len(x) * np.eye(len(w)) * 0.01 + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * len(x) * 0.01 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of the id so that every run and partitioning chooses the same.

    A count tells below which hash about enough rows lie, so that partitions offer those and not ``limit`` rows each.
    """
    n, share = rows.count(), 1.0
    hashed = F.xxhash64("doc_id")
    if n > limit:
        share = 1.1 * limit / n + 100 / n
        below = lambda: hashed.cast("double") < F.lit((share - 0.5) * 2.0**64)
        while share < 1 and rows.filter(below()).count() < limit:
            share *= 2
        if share < 1:
            rows = rows.filter(below())
    return rows.orderBy(hashed, "doc_id").limit(limit)
