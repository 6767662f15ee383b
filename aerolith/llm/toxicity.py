"""Toxicity by class-conditional Kneser-Ney models: how much likelier a text's words are among toxic texts."""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from aerolith.llm.common import batch, crc_fold, discard, documents, saved
from aerolith.llm.learning import bounded, logistic

# Bounds on what the classifier is fitted on: labelled texts per class for the counts, and texts for the calibration.
MAX_TOXIC, MAX_ORDINARY = 8000, 24_000
MAX_CALIBRATION = 20_000
WINDOW = 8
# Evidence of a word, and what a pair adds to it, counts half if it was met so often; chosen on the calibration fold.
HALF_WORD, HALF_PAIR = 3, 40
# A task sends its word counts on whenever it holds so many words.
OPEN_WORDS = 200_000
MOST = 6.0
THRESHOLD = 0.3
MEASURES = ("whole", "mean", "peak", "size")
# Words that are looked up together.
SLICE_WORDS = 100_000
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_…«»“”"
UNKNOWN, START = 0, 1
# Words are known by Spark's xxhash64, so that the driver and every worker hold numbers only.
SEED = 42


def words_of(text: str) -> list[str]:
    """Lower-case words without the marks around them."""
    return [w for x in text.lower().split() if (w := x.strip(EDGE))]


@dataclass
class Counts:
    """What the models are made of; pairs count the texts that have word b after word a, not their repeats.

    ``words``: word, kinds of pairs ending in it in ordinary and in toxic texts, its shared count (texts of the whole
    corpus that have it), and pairs starting with it in ordinary and in toxic texts. ``pairs``: a (None starts a
    text), b, ordinary, toxic. ``totals``: both kinds of pairs and the shared counts over all words. Words and pairs
    are rows, or arrays of their columns with hashes of the words (0 for None); fitting uses the pairs up.
    """

    words: list[tuple] | list[np.ndarray]
    start: tuple[int, int]
    pairs: list[tuple] | list[np.ndarray]
    totals: tuple[int, int, int]


def trust(met: np.ndarray, half: int) -> np.ndarray:
    """How much evidence counts that was met so often: nearly none once, half at ``half``, nearly all far beyond it."""
    n = met.astype(np.float32) ** 2
    return n / (n + np.float32(half**2))


def _hashes(words: list[str | None]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((0 if w is None else digest(w.encode(), SEED) for w in words), np.uint64, len(words)).view(np.int64)


def _numbers(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(hashes), UNKNOWN, np.int64)
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at + 2, UNKNOWN)


def _columns(rows: list, n: int, words: int) -> list[np.ndarray]:
    """The ``n`` columns of ``rows``, the first ``words`` of them as hashes; arrays stay as they are."""
    if rows and isinstance(rows[0], np.ndarray):
        return rows
    columns = list(zip(*rows)) or [()] * n
    return [_hashes(c) if i < words else np.array(c, np.int64) for i, c in enumerate(columns)]


_BLOCK = pa.schema([("block", pa.binary())])


def _arrays(df: DataFrame, kinds: list[type]) -> list[np.ndarray]:
    """The numeric columns of the written table ``df`` as arrays: they travel as bytes, one block after the other."""
    row = np.dtype([(str(i), kind) for i, kind in enumerate(kinds)])

    def run(batches):
        for b in batches:
            block = np.empty(b.num_rows, row)
            for i in range(len(kinds)):
                block[str(i)] = b.column(i).to_numpy(zero_copy_only=False)
            yield batch(_BLOCK, [block.tobytes()])

    columns = [np.empty(df.count(), kind) for kind in kinds]
    at = 0
    for r in df.mapInArrow(run, "block binary").toLocalIterator():
        block = np.frombuffer(r[0], row)
        for i, c in enumerate(columns):
            c[at : at + len(block)] = block[str(i)]
        at += len(block)
    return columns


@dataclass
class Model:
    """Kneser-Ney estimates of both classes as arrays over a shared vocabulary.

    A bigram's estimate is its discounted share after the first word, plus that word's left-over mass times the
    class's continuation share of the second; the latter backs off in the same way to the share of the word in the
    whole corpus, labelled or not, which both classes have in common. Every word and pair of the labelled texts is
    kept; ``trust`` shrinks the evidence of rare ones by how often they were met, in kinds of pairs or in texts.
    """

    vocabulary: np.ndarray  # hashes of the words, sorted; the number of a word is its place plus 2
    keys: np.ndarray  # first * size + second, sorted
    shares: np.ndarray  # (2, keys): discounted share of each class
    left: np.ndarray  # (2, words): left-over mass after a word
    continuation: np.ndarray  # (2, words)
    word_trust: np.ndarray  # (words,)
    pair_met: np.ndarray  # (keys,): texts that have the pair, 65,535 standing for more

    @classmethod
    def fit(cls, counts: Counts, discount: float = 0.75) -> "Model":
        hashes, *columns = _columns(counts.words, 6, 1)
        counts.words = []
        order = np.argsort(hashes)
        vocabulary = hashes[order]
        size = len(vocabulary) + 2
        table = np.zeros((4, size), np.float32)  # counts of a bounded sample: whole numbers that four bytes hold
        pooled = np.zeros(size)
        for i, c in enumerate(columns):
            (pooled if i == 2 else table[i - (i > 2)])[2:] = c[order]
        del hashes, columns, order
        types, after = table[:2], table[2:]
        after[:, 1] = counts.start
        pooled = np.maximum(pooled, discount) / max(1, counts.totals[2])
        continuation = np.empty((2, size))
        for c in (0, 1):
            n, kinds = counts.totals[c], np.count_nonzero(types[c])
            continuation[c] = (np.maximum(types[c] - discount, 0) + discount * kinds * pooled) / n if n else pooled
        del pooled
        keys, b, o, t = _columns(counts.pairs, 4, 2)
        counts.pairs = []
        # In steps and in place: at the bounds of the sample a column takes tens of MB.
        steps = [slice(i, i + (1 << 18)) for i in range(0, len(keys), 1 << 18)]
        for x in steps:
            keys[x] = np.where(keys[x] == 0, START, _numbers(vocabulary, keys[x])) * size + _numbers(vocabulary, b[x])
        del b
        order = np.argsort(keys)
        o, t = o[order], t[order]
        keys = keys[order]
        del order
        shares = np.empty((2, len(keys)), np.float32)
        pair_met = np.empty(len(keys), np.uint16)
        left = np.ones((2, size))
        for x in steps:
            first = keys[x] // size
            for c, n in enumerate((o[x], t[x])):
                shares[c, x] = np.maximum(n.astype(float) - discount, 0) / np.maximum(after[c][first], 1)
                np.subtract.at(left[c], first, shares[c, x])
            pair_met[x] = np.minimum(o[x].astype(np.int64) + t[x], 2**16 - 1)
        met = np.maximum(types.sum(0), after.sum(0))
        return cls(
            vocabulary, keys, shares, np.maximum(left, 1e-6), continuation,
            trust(met, HALF_WORD), pair_met,
        )

    def scorer(self) -> "Scorer":
        """What scoring needs of the estimates, in four bytes a number."""
        alone = np.maximum(self.continuation, 1e-12)
        pair, seconds = np.empty(len(self.keys), np.float32), np.empty(len(self.keys), np.int32)
        size = self.continuation.shape[1]
        for i in range(0, len(pair), 1 << 18):
            x = slice(i, i + (1 << 18))
            first, second = self.keys[x] // size, self.keys[x] % size
            p = np.maximum(self.left[:, first] * self.continuation[:, second] + self.shares[:, x], 1e-12)
            pair[x] = np.log(p[1] / p[0])
            seconds[x] = second
        return Scorer(
            self.vocabulary, np.log(alone[1] / alone[0]).astype(np.float32), self.word_trust,
            np.log(self.left[1] / self.left[0]).astype(np.float32),
            np.searchsorted(self.keys, np.arange(size + 1) * size), seconds, pair, self.pair_met,
        )

    def log_odds(self, words: list[str]) -> np.ndarray:
        return self.scorer().log_odds(words)

    def measures(self, texts: list[list[str]]) -> np.ndarray:
        return self.scorer().measures(texts)


@dataclass
class Scorer:
    """Log odds of the estimates of both classes, as the workers look them up."""

    vocabulary: np.ndarray
    odds: np.ndarray  # of a word alone, by its number
    word_trust: np.ndarray
    back: np.ndarray  # of the left-over mass after a word
    begins: np.ndarray  # where the pairs of a first word begin; they end where the next one's begin
    seconds: np.ndarray  # second words of the pairs, by first word and then sorted
    pair: np.ndarray  # of a known pair
    pair_met: np.ndarray

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where the pairs stand, -1 for unknown ones: all are halved into at once, each among those of its first word."""
        at, end = self.begins[first], self.begins[first + 1]
        ends = end.copy()
        while (open_ := at < end).any():
            middle = (at + end) >> 1
            less = open_ & (self.seconds[np.minimum(middle, len(self.seconds) - 1)] < second)
            at = np.where(less, middle + 1, at)
            end = np.where(open_ & ~less, middle, end)
        met = at < ends
        met[met] = self.seconds[at[met]] == second[met]
        return np.where(met, at, -1)

    def evidence(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word number ``second`` after ``first`` the log of its probability in toxic texts over that in ordinary
        ones: by the models, and as far as it is trusted. Unknown words are no evidence.

        Trusted odds are those of the word alone and what a known pair adds, each by how often it was met.
        """
        odds = self.odds[second]
        whole = odds + self.back[first]  # what an unseen pair backs off to
        trusted = odds * self.word_trust[second]
        known = np.flatnonzero((first != UNKNOWN) & (second != UNKNOWN))
        if len(self.seconds) and len(known):
            at = self.places(first[known], second[known])
            known, at = known[at >= 0], at[at >= 0]
            whole[known] = self.pair[at]
            trusted[known] += (self.pair[at] - odds[known]) * trust(self.pair_met[at], HALF_PAIR)
        unknown = second == UNKNOWN
        whole[unknown] = trusted[unknown] = 0.0
        return whole, trusted

    def log_odds(self, words: list[str]) -> np.ndarray:
        """Trusted log odds of the words of one text."""
        second = _numbers(self.vocabulary, _hashes(words))
        return self.evidence(np.concatenate(([START], second[:-1])), second)[1]

    def measures(self, texts: list[list[str]]) -> np.ndarray:
        """A row of MEASURES for each text, given as its words.

        The words of all texts are looked up together: each distinct word is hashed and found once. ``whole`` is the
        difference of the two models' log-likelihoods a word. ``mean`` and ``peak`` are additions to it, for long texts
        that are toxic in a few places: trusted odds for toxicity a word, odds against it counting as none (a
        passage that only ordinary texts quote does not excuse what stands beside it), over the text and over its
        WINDOW words that look most toxic. More windows have a higher peak by chance, so that ``size``, the log of
        their number, goes with it.
        """
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
        second = _numbers(self.vocabulary, _hashes(list(number)))[at] if len(at) else at
        first = np.concatenate(([START], second[:-1]))
        ends = np.cumsum([len(words) for words in texts])
        first[ends[:-1][ends[:-1] < len(second)]] = START
        whole, trusted = self.evidence(first[: len(second)], second)
        odds = np.clip(trusted, 0, MOST)
        out = np.zeros((len(texts), len(MEASURES)))
        for i, (end, words) in enumerate(zip(ends.tolist(), texts)):
            if n := len(words):
                mine = odds[end - n : end]
                sums = np.concatenate(([0.0], np.cumsum(mine)))
                peak = (sums[WINDOW:] - sums[:-WINDOW]).max() if n > WINDOW else sums[-1]
                out[i] = whole[end - n : end].mean(), sums[-1] / n, peak / WINDOW, np.log(max(1, n - WINDOW + 1))
        return out


_WORDS = pa.schema([("b", pa.string()), ("shared", pa.int64())])


def corpus_words(docs: DataFrame, most: int = OPEN_WORDS) -> DataFrame:
    """``b, shared``: every word of ``docs`` with the number of texts that have it, all whole texts being read.

    Each task counts its own texts first and holds no more than ``most`` words and those of one text.
    """

    def run(batches):
        found = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(set(words_of(t)))
                if len(found) >= most:
                    yield batch(_WORDS, list(found), list(found.values()))
                    found = Counter()
        if found:
            yield batch(_WORDS, list(found), list(found.values()))

    counted = documents(docs).select("text").mapInArrow(run, "b string, shared long")
    return counted.groupBy("b").agg(F.sum("shared").alias("shared"))


_PAIRS = pa.schema([("toxic", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def text_pairs(texts: DataFrame) -> DataFrame:
    """``toxic, a, b``: the distinct pairs of neighbouring words of each text as hashes; 0 stands before the first word."""

    def run(batches):
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                if words:
                    number: dict[str, int] = {}
                    second = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + 1
                    hashes = np.concatenate(([0], _hashes(list(number))))
                    keys = np.unique(np.concatenate(([0], second[:-1])) * len(hashes) + second)
                    yield batch(_PAIRS, np.full(len(keys), toxic, np.int64), hashes[keys // len(hashes)], hashes[keys % len(hashes)])

    return texts.select(F.col("toxic").cast("long"), "text").mapInArrow(run, "toxic long, a long, b long")


def count(texts: DataFrame, corpus: DataFrame, most: int = MAX_TOXIC + MAX_ORDINARY) -> Counts:
    """Counts over the labelled ``text, toxic`` (0 or 1) and ``corpus``, the ``corpus_words`` of all texts.

    Made by Spark from the same words as are scored; all words and pairs of the labelled texts, which are a bounded
    sample of ``most`` rows, reach the driver, as numbers. Tables written on the way are deleted again.
    """
    pairs = saved(
        text_pairs(texts).groupBy("a", "b").agg(F.sum(1 - F.col("toxic")).cast("int").alias("o"), F.sum("toxic").cast("int").alias("t")),
        "word-pairs",
    )
    has = lambda c: F.sum((F.col(c) > 0).cast("long"))
    ends = pairs.groupBy("b").agg(has("o").alias("ko"), has("t").alias("kt"))
    begins = pairs.filter("a != 0").groupBy(F.col("a").alias("b")).agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    shared = corpus.select(F.xxhash64("b").alias("b"), "shared")
    both = ends.join(shared, "b", "left").join(begins, "b", "left")
    known = saved(both.select("b", "ko", "kt", *(zero(c).alias(c) for c in ("shared", "o", "t"))), "known-words")
    kinds = known.agg(*(zero(F.sum(c)) for c in ("ko", "kt"))).first()
    start = pairs.filter("a = 0").agg(zero(F.sum("o")), zero(F.sum("t"))).first()
    counts = Counts(
        _arrays(known, [np.int64, *[np.int32] * 5]),
        tuple(start),
        _arrays(pairs.select("a", "b", "o", "t"), [np.int64, np.int64, *[np.uint16 if most < 2**16 else np.int32] * 2]),
        (*kinds, corpus.agg(zero(F.sum("shared"))).first()[0]),
    )
    discard(pairs)
    discard(known)
    return counts


_ARROW = pa.schema([("doc_id", pa.int64())] + [(c, pa.float64()) for c in MEASURES])
_ARROW_SQL = "doc_id long, " + ", ".join(f"{c} double" for c in MEASURES)


def measure(docs: DataFrame, model) -> DataFrame:
    """``doc_id`` and MEASURES of every row; ``model`` is a broadcast Scorer."""

    def of(ids, texts):
        got = model.value.measures(texts)
        return batch(_ARROW, pa.array(ids, pa.int64()), *(pa.array(c) for c in got.T))

    def run(batches):
        for b in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py())
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held >= SLICE_WORDS:
                    yield of(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield of(ids, texts)

    return documents(docs).mapInArrow(run, _ARROW_SQL)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    max_toxic: int = MAX_TOXIC,
    max_ordinary: int = MAX_ORDINARY,
    max_calibration: int = MAX_CALIBRATION,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; ``labels`` has ``doc_id, toxic`` (0 or 1).

    Counts come from labelled texts of folds 0 and 1 (crc32 of the id as text, modulo 4), the calibration of the
    MEASURES, first of all the length-normalised difference of the log-likelihoods, from fold 3; fold 2 is held out. Both are bounded samples of whole texts. The counts
    that both classes back off to come from every text, labelled or not. Null and blank texts get the score of a text that says nothing. Null labels are no labels; repeated labels count once, the
    higher one. Without labels, or of one class only, every score is the share of toxic labels (0 without any).
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    fold = crc_fold(F.col("doc_id"))
    learn = saved(
        bounded(marked.filter((F.col("toxic") == 1) & fold.isin(0, 1)), max_toxic)
        .unionByName(bounded(marked.filter((F.col("toxic") == 0) & fold.isin(0, 1)), max_ordinary))
        .withColumn("use", F.lit("count"))
        .unionByName(bounded(marked.filter(fold == 3), max_calibration).withColumn("use", F.lit("calibrate"))),
        "learn",
    )
    texts = saved(documents(docs).join(F.broadcast(learn), "doc_id"), "learn-texts")
    corpus = saved(corpus_words(docs), "corpus-words")
    counts = count(texts.filter("use = 'count'"), corpus, max_toxic + max_ordinary)
    discard(corpus)
    model = spark.sparkContext.broadcast(Model.fit(counts).scorer())
    held = texts.filter("use = 'calibrate'")
    known = measure(held, model).join(F.broadcast(learn.select("doc_id", "toxic")), "doc_id").collect()
    discard(texts)
    discard(learn)
    y = np.array([r["toxic"] for r in known], float)
    x = np.array([[r[c] for c in MEASURES] for r in known], float).reshape(-1, len(MEASURES))
    if 0 < y.sum() < len(y):
        w = logistic(x, y)
    else:
        share = float(y.mean()) if len(y) else 0.0
        w = np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9))] + [0.0] * len(MEASURES))
    odds = F.lit(float(w[0]))
    for c, v in zip(MEASURES, w[1:]):
        odds += float(v) * F.col(c)
    return measure(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id")) == 2).alias("held_out"), (1 / (1 + F.exp(-odds))).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
