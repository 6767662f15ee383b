"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes."""

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from aerolith.llm.common import saved
from aerolith.llm.text_stats import text_stats

MIN_WORDS = 50
# Vote patterns are gathered for EM: 3 ** rules of them at most, whatever the size of the corpus.
MAX_RULES = 10


def _share(part: str, whole: str) -> str:
    return f"{part} / greatest({whole}, 1)"


# Each rule: a measure, when it votes against a text, and when for it; between the two it abstains.
RULES = {
    "symbols": (_share("n_symbols", "n_words"), "x > 0.1", "x < 0.02"),
    "dup_lines": (_share("n_dup_lines", "n_lines"), "x > 0.3", "x < 0.05 and n_lines > 1"),
    "repeats": (_share("n_repeat_words", "n_words"), "x > 0.3", "x < 0.1"),
    "word_length": (_share("word_chars", "n_words"), "x < 3 or x > 10", "x between 3.5 and 8"),
    "upper_case": (_share("n_upper_words", "n_words"), "x > 0.4", "x < 0.15"),
    "letters": (_share("n_letter_words", "n_words"), "x < 0.7", "x > 0.9"),
    "function_words": (_share("n_function_words", "n_words"), "x < 0.02 and n_words >= 50", "x > 0.08"),
    "closed_lines": (_share("n_closed_lines", "n_lines"), "x < 0.1", "x > 0.5"),
    "exclaims": (_share("n_exclaims", "n_words"), "x > 0.25", "x < 0.05"),
    "digits": (_share("n_digits", "word_chars"), "x > 0.3", "x < 0.1"),
}


def votes(stats: DataFrame, rules: Mapping[str, tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds a column per rule: -1 against, 1 for, 0 abstains."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    for name, (measure, against, favour) in rules.items():
        vote = F.expr(f"case when {against} then -1 when {favour} then 1 else 0 end")
        stats = stats.withColumn("x", F.expr(measure)).withColumn(f"v_{name}", vote)
    return stats.drop("x")


class Weights:
    """What EM has learned: the prior, and per rule the log odds of a vote for and against.

    ``right`` and ``wrong`` are the chances that a vote on a good text is for it, and on a bad text against it.
    """

    def __init__(self, prior: float, good: np.ndarray, bad: np.ndarray):
        self.prior, self.good, self.bad = prior, good, bad
        self.base = math.log(prior / (1 - prior))
        self.favour = np.log(good / (1 - bad))
        self.against = np.log((1 - good) / bad)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = self.base + (patterns > 0) @ self.favour + (patterns < 0) @ self.against
        return 1 / (1 + np.exp(-odds))

    def column(self, names: Sequence[str]) -> Column:
        odds = F.lit(float(self.base))
        for name, f, a in zip(names, self.favour, self.against):
            odds += F.when(F.col(name) > 0, float(f)).when(F.col(name) < 0, float(a)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, trust: float = 0.05) -> Weights:
    """Accuracies and prior by EM over vote patterns and their counts.

    A rule that abstains says nothing. It starts from the majority of the votes, and every accuracy has a prior worth
    ``trust`` of the corpus that favours rules better than chance, so that the two classes cannot change places.
    """
    rules = patterns.shape[1]
    total = max(1.0, counts.sum())
    favour, against = (patterns > 0).astype(float), (patterns < 0).astype(float)
    # A single vote against a text weighs as much as the votes of all rules that did not notice its kind of junk.
    p = np.where(against.sum(1) == 0, 0.95, 1 / (1 + np.exp(2 * against.sum(1) - 1)))
    mass = trust * total
    weights = Weights(0.8, np.full(rules, 0.8), np.full(rules, 0.6))
    for _ in range(rounds):
        g, b = counts * p, counts * (1 - p)
        good = (g @ favour + 0.9 * mass) / (g @ (favour + against) + mass)
        bad = (b @ against + 0.6 * mass * 0.2) / (b @ (favour + against) + mass * 0.2)
        prior = (g.sum() + 0.8 * mass) / (total + mass)
        weights = Weights(prior, np.clip(good, 0.5, 0.9999), np.clip(bad, 0.01, 0.9999))
        q = weights.posterior(patterns)
        if np.abs(q - p).max(initial=0) < 1e-9:
            break
        p = q
    return weights


def quality_rules(docs: DataFrame, rules: Mapping[str, tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, the ``quality`` posterior and ``kept`` for every row of ``docs``.

    A text under 50 words, or with more than half of its words in repeated three-word windows, fails outright; all
    others are kept if the posterior reaches ``threshold``. EM sees the vote patterns of all rows with their counts.
    Null and blank texts count zero words and fail; repeated rows are judged alike; an empty table gives no rows.
    """
    names = [f"v_{n}" for n in rules]
    voted = saved(votes(text_stats(docs), rules), "votes")
    rows = voted.groupBy(*names).count().collect()
    table = np.array([list(r) for r in rows], float).reshape(-1, len(names) + 1)
    weights = fit(table[:, :-1], table[:, -1])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "quality": weights.column(names)}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", *names,
    )
