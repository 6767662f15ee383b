"""Quality classifier by co-training: a text view and a metadata view teach each other, and both are combined."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from aerolith.llm.common import crc_fold, saved
from aerolith.llm.learning import bounded, logistic
from aerolith.llm.text_stats import text_stats

# Bounds on the rows that the two classifiers are fitted on: labelled, for calibration, and unlabelled.
MAX_LABELLED, MAX_CALIBRATION, MAX_UNLABELLED = 20_000, 10_000, 20_000
ROUNDS = 4
# A view is confident above this probability of either class, and passes on at most so many rows of a class in a round.
CONFIDENT, PASSED_ON = 0.97, 500
SOURCES = 16
LANGS = ("en", "de", "fr", "es")

_PER_WORD, _PER_LINE = "greatest(n_words, 1)", "greatest(n_lines, 1)"
TEXT_VIEW = {
    "symbols": f"least(n_symbols / {_PER_WORD}, 3)",
    "some_symbols": f"cast(n_symbols > 0.05 * {_PER_WORD} as double)",
    "dup_lines": f"n_dup_lines / {_PER_LINE}",
    "repeats": f"n_repeat_words / {_PER_WORD}",
    "word_length": f"least(word_chars / {_PER_WORD}, 30)",
    "upper": f"n_upper_words / {_PER_WORD}",
    "letters": f"n_letter_words / {_PER_WORD}",
    "function_words": f"n_function_words / {_PER_WORD}",
    "closed_lines": f"n_closed_lines / {_PER_LINE}",
    "exclaims": f"least(n_exclaims / {_PER_WORD}, 3)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "size": "ln(1 + n_words)",
}
META_VIEW = {
    "chars": "ln(1 + coalesce(greatest(n_chars, 0), 0))",
    "no_chars": "cast(n_chars is null as double)",
    **{f"lang_{x}": f"cast(coalesce(lang = '{x}', false) as double)" for x in LANGS},
    **{f"source_{i}": f"cast(pmod(xxhash64(coalesce(source, '')), {SOURCES}) = {i} as double)" for i in range(SOURCES)},
}


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, t, m``: the features of both views as arrays, one row per row of ``docs``.

    The text view counts over whole texts; the metadata view knows language, source and stated length alone.
    """
    meta = {
        "lang": F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string"),
        "source": F.col("source") if "source" in docs.columns else F.lit(None).cast("string"),
        "n_chars": F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long"),
    }
    plain = docs.select("doc_id", "text", *(c.alias(n) for n, c in meta.items()))
    return text_stats(plain, tuple(meta)).select("doc_id", _array(TEXT_VIEW).alias("t"), _array(META_VIEW).alias("m"))


def _array(view: dict[str, str]) -> Column:
    return F.array(*(F.expr(f"cast({e} as double)") for e in view.values()))


@dataclass
class View:
    """A logistic regression on standardised features, and the calibration of its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray, held_y: np.ndarray) -> "View":
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        view = cls(mean, scale, logistic((x - mean) / scale, y, penalty=0.1))
        if 0 < held_y.sum() < len(held_y):
            view.shift, view.slope = map(float, logistic(view.odds(held)[:, None], held_y))
        return view

    def odds(self, x: np.ndarray) -> np.ndarray:
        raw = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return self.shift + self.slope * np.clip(raw, -20, 20)

    def column(self, features: str) -> Column:
        """The same log odds as a column over an array of features."""
        w = self.weights[1:] / self.scale
        raw = F.lit(float(self.weights[0] - (self.mean * w).sum()))
        for i, v in enumerate(w.tolist()):
            raw += F.lit(v) * F.get(features, F.lit(i))
        return F.lit(self.shift) + F.lit(self.slope) * F.greatest(F.least(raw, F.lit(20.0)), F.lit(-20.0))


@dataclass
class Rows:
    """Features of both views and labels of a bounded sample."""

    x: tuple[np.ndarray, np.ndarray]
    y: np.ndarray

    @classmethod
    def of(cls, df: DataFrame) -> "Rows":
        rows = df.select("t", "m", "label").collect()
        x = tuple(np.array([r[c] for r in rows], float).reshape(len(rows), n) for c, n in (("t", len(TEXT_VIEW)), ("m", len(META_VIEW))))
        return cls(x, np.array([np.nan if r["label"] is None else r["label"] for r in rows], float))


def co_train(labelled: Rows, held: Rows, unlabelled: Rows, rounds: int = ROUNDS, passed_on: int = PASSED_ON) -> tuple[list[View], np.ndarray]:
    """Both views after the rounds, and the weights that combine their calibrated log odds (the intercept first).

    In a round each view is fitted on the labels and on what the other one has passed on, and is calibrated on held
    rows. Unlabelled rows of which it is confident go, with that label, to the other view; a view that cannot tell the
    classes apart is never confident once calibrated, and so passes nothing on.
    """
    extra: list[tuple[list[int], list[float]]] = [([], []), ([], [])]
    fitted: list[View] = []
    for step in range(rounds + 1):
        fitted = []
        for v in (0, 1):
            at, labels = extra[v]
            x = np.concatenate([labelled.x[v], unlabelled.x[v][at]])
            fitted.append(View.fit(x, np.concatenate([labelled.y, labels]), held.x[v], held.y))
        if step == rounds or not len(unlabelled.x[0]):
            break
        new = 0
        for v in (0, 1):
            p = 1 / (1 + np.exp(-fitted[v].odds(unlabelled.x[v])))
            at, labels = extra[1 - v]
            free = np.setdiff1d(np.arange(len(p)), at)
            for label, sure in ((1.0, p[free]), (0.0, 1 - p[free])):
                best = free[np.argsort(-sure, kind="stable")[:passed_on]]
                best = best[(p[best] if label else 1 - p[best]) >= CONFIDENT]
                at += best.tolist()
                labels += [label] * len(best)
                new += len(best)
        if not new:
            break
    both = np.column_stack([fitted[v].odds(held.x[v]) for v in (0, 1)])
    if 0 < held.y.sum() < len(held.y):
        return fitted, logistic(both, held.y)
    return fitted, np.array([0.0, 1.0, 0.0])


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
    max_calibration: int = MAX_CALIBRATION,
    max_unlabelled: int = MAX_UNLABELLED,
) -> DataFrame:
    """``doc_id, held_out, text_score, meta_score, score, kept`` for every row of ``docs``; ``labels`` has ``doc_id, quality``.

    Folds 0 and 1 (crc32 of the id as text, modulo 4) give labels to learn from, fold 3 calibrates and combines, fold 2
    is held out; documents without a label are the unlabelled pool. All three are bounded samples. Scores are
    probabilities of good quality. Null texts are empty, missing metadata has features of its own, null labels are none and of
    repeated labels the higher one counts. Without labels of both classes all scores are the share of good labels (1
    without any). An empty table gives no rows.
    """
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = saved(features(docs), "views")
    known = rows.select("doc_id", "t", "m").join(marked, "doc_id", "left").dropDuplicates(["doc_id"])
    fold = crc_fold(F.col("doc_id"))
    has = F.col("label").isNotNull()
    labelled = Rows.of(bounded(known.filter(has & fold.isin(0, 1)), max_labelled))
    held = Rows.of(bounded(known.filter(has & (fold == 3)), max_calibration))
    out = rows.withColumn("held_out", fold == 2)
    if 0 < labelled.y.sum() < len(labelled.y):
        pool = Rows.of(bounded(known.filter(~has), max_unlabelled))
        (text, meta), w = co_train(labelled, held, pool)
        odds = F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("text_odds") + F.lit(float(w[2])) * F.col("meta_odds")
        out = out.withColumns({"text_odds": text.column("t"), "meta_odds": meta.column("m")}).withColumn("odds", odds)
        for name in ("text_", "meta_", ""):
            out = out.withColumn(f"{name}score", 1 / (1 + F.exp(-F.col(f"{name}odds"))))
    else:
        share = float(labelled.y.mean()) if len(labelled.y) else 1.0
        out = out.withColumns({f"{name}score": F.lit(share) for name in ("text_", "meta_", "")})
    return out.select("doc_id", "held_out", "text_score", "meta_score", "score", (F.col("score") >= threshold).alias("kept"))
