"""Counts over whole texts that the quality operators build on."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Frequent function words of the corpus languages (English, German, French, Spanish).
FUNCTION_WORDS = frozenset(
    b"the and of to in is that for it was on are as with be by this at "
    b"der die und das von den mit zu ist nicht ein eine sich auf im "
    b"de la le les et des que en un une pour qui dans est "
    b"el los las del por con una para se".split()
)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 3
STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words",
    "n_letter_words", "n_function_words", "n_closed_lines", "n_exclaims", "n_digits",
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three words whose sequence the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base = len(number) + 1
    if base < 2_000_000:
        keys = (at[:-2] * base + at[1:-1]) * base + at[2:]
    else:  # three numbers no longer fit one long: number the pairs first
        pairs = np.unique(at[:-1] * base + at[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * base + at[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + n] |= twice
    return int(covered.sum())


def stats(text: str) -> tuple[int, ...]:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        sum(1 for w in words if w.strip(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")),
        sum(map(FUNCTION_WORDS.__contains__, words)),
        sum(1 for x in lines if x.rstrip(SPACES).endswith((".", "!", "?", '"', ":", "…"))),
        text.count("!"),
        sum(text.count(c) for c in "0123456789"),
    )


def text_stats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``carry`` and the counts of STATS for every row; a null text counts as empty."""
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry
    )
    counts = T.StructType([T.StructField(c, T.LongType()) for c in STATS])
    schema = T.StructType([f for f in given.schema if f.name != "text"] + counts.fields)

    def run(batches):
        for b in batches:
            rows = np.array([stats(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            kept = {n: b.column(n) for n in ("doc_id", *carry)}
            yield pa.RecordBatch.from_pydict(kept | {c: pa.array(rows[:, i]) for i, c in enumerate(STATS)})

    return given.mapInArrow(run, schema)
