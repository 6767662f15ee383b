import random

import pytest

# Extra columns carry names that the operators use inside.
ODD = "doc_id long, text string, lang string, source string, n_chars long, fp long, n long, keep_id long, h long, least long, key long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text) pairs, with extra columns of clashing names."""
        full = [(i, t, None, "s", None if t is None else len(t), 7, 7, 7, 7, 7, 7) for i, t in rows]
        return spark.createDataFrame(full, ODD)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long text, ties, repeated rows, and copies that differ in white space."""
    rng = random.Random(5)
    words = [f"{rng.choice('abcde')}{i % 97}" for i in range(60_000)]
    return [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "one"),
        (5, "one  two"),
        (6, "one\ttwo"),
        (6, "one\ttwo"),
        (7, "One two"),
        (8, "naïve ¿café? 😀  x"),
        (9, " ".join(words)),
        (10, " ".join(words[:500])),
        (11, " ".join(words[:500])),
        (12, " ".join(words[:499] + ["zz"])),
        (None, "one two"),
        (13, "line\nline\nline\n\nother"),
    ]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
