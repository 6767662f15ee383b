"""Secret scans: patterns find candidates, and a random forest removes the false ones.

DataFrame functions only: texts never leave the JVM.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.llm.common import discard, saved
from aerolith.llm.learning import bounded

# Words that stand beside secrets, beside harmless hashes and numbers, and in stand-ins for secrets.
SECRET_WORDS = "token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
HARMLESS_WORDS = "commit|sha1|sha256|md5|hash|checksum|digest|etag|revision|uuid|guid|isbn|issn|doi|order|phone|id"
STAND_INS = r"example|sample|dummy|your|change_?me|placeholder|x{6}|0{8}|1234567|[*]{4}|[.]{3}"
PREFIXES = "AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk-|sk_live_|eyJ"
# What a word for secrets assigns, of six or more characters: the value alone, without the key and closing marks.
_VALUE = r"[^\s\"'<>,;&()\[\]{}]"
ASSIGNED = (
    r"(?<=[:=][ \t]{0,2}[\"']?)"  # rules out most places at little cost
    rf"(?<=(?i:{SECRET_WORDS})[A-Za-z0-9_-]{{0,16}}[\"']?[ \t]{{0,2}}[:=][ \t]{{0,2}}[\"']?)"
    rf"{_VALUE}{{5,}}[^\s\"'<>,;&()\[\]{{}}.:?!]"
)
# Elsewhere a run of 16 or more characters of keys and tokens, with a digit or a known prefix; = is its padding or no part.
RUN = (
    rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9]|{PREFIXES})[A-Za-z0-9+/_-]{{16,}}"
    r"(?:={1,2}(?![A-Za-z0-9+/=_\"'-]))?"
)
CANDIDATE = f"{ASSIGNED}|{RUN}"
BEFORE, AFTER = 48, 8
MASK = "<secret>"
THRESHOLD = 0.5
# The forest is fitted on candidates of at most so many texts, and on at most so many rows.
MAX_TEXTS, MAX_LABELLED = 1000, 40_000
TREES, DEPTH, SEED = 24, 7, 7
# The dictionary also takes the words that most texts have: at most so many, each in at least so many texts.
MAX_WORDS, MIN_TEXTS = 600, 5
# Common words of identifiers, file names and addresses.
DICTIONARY = (
    "the|and|for|with|from|this|that|not|are|was|have|name|file|path|page|post|news|article|image|img|photo|video|"
    "index|main|test|data|user|admin|config|setting|value|type|list|item|order|number|date|time|day|month|year|key|"
    "token|secret|api|http|https|www|com|org|net|html|css|js|json|xml|png|jpg|version|release|build|long|short|"
    "identifier|string|text|line|word|here|your|default|class|function|method|object|table|column|row|server|client"
)
FEATURES = (
    "length digits upper transitions distinct alternation hex dictionary separators slashes in_path doc_path "
    "secret_word harmless_word assigned quoted stand_in prefix"
).split()


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern).cast("double")


def coverage(candidate: Column, words: Sequence[str] = ()) -> Column:
    """The share of a candidate's letters that DICTIONARY and ``words`` cover, longer words first; 0 without letters."""
    every = sorted({*DICTIONARY.split("|"), *words}, key=lambda w: (-len(w), w))
    letters = F.regexp_replace(F.lower(candidate), "[^a-z]+", " ")
    n = F.char_length(F.replace(letters, F.lit(" "), F.lit("")))
    left = F.char_length(F.regexp_replace(letters, "|".join(every) + "| ", ""))
    return F.when(n > 0, 1 - left / n).otherwise(0.0)


def features(found: DataFrame, words: Sequence[str] = ()) -> DataFrame:
    """Adds the columns of FEATURES to ``candidate, before, after, path`` (the path of the document, null if it has none)."""
    c, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    near = F.right(before, F.lit(24))
    return found.withColumns(
        {
            "length": n,
            "digits": count("[0-9]"),
            "upper": count("[A-Z]"),
            "transitions": count("(?<=[a-z])(?=[0-9A-Z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[0-9])(?=[A-Za-z])"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "alternation": count("(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
            "hex": _has(c, "^([0-9a-f]+|[0-9A-F]+)$"),
            "dictionary": coverage(c, words),
            "separators": count("[-_]"),
            "slashes": count("[/+=]"),
            "in_path": _has(before, r"(?i)(://|www\.|/)\S*$"),
            "doc_path": F.coalesce(_has(F.col("path"), "(?i)test|example|sample|docs?/|lock|fixture"), F.lit(0.0)),
            "secret_word": _has(near, f"(?i)({SECRET_WORDS})"),
            "harmless_word": _has(near, rf"(?i)\b({HARMLESS_WORDS})\b"),
            "assigned": _has(before, r"[:=]\s*[\"']?$"),
            "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
            "stand_in": _has(c, f"(?i)({STAND_INS})"),
            "prefix": _has(c, f"^({PREFIXES})"),
        }
    )


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """``key, at, start, candidate, before, after, path`` of every candidate in ``key, text, path``, and columns to ``keep``.

    Rows that are repeated share a key: their candidates are found once.
    """
    n = F.size("hits")
    between = lambda i: F.slice("between", i, n)
    parts = docs.filter(F.col("text").rlike(CANDIDATE)).select(
        "key",
        "path",
        *keep,
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hits"),
        F.split("text", CANDIDATE, -1).alias("between"),
    )
    found = F.arrays_zip(
        F.col("hits").alias("candidate"),
        F.transform(between(1), F.char_length).alias("skipped"),
        F.transform(between(1), lambda b: F.right(b, F.lit(BEFORE))).alias("before"),
        F.transform(between(2), lambda b: F.left(b, F.lit(AFTER))).alias("after"),
    )
    once = parts.groupBy("key").agg(F.min(F.struct("path", *keep, found.alias("found"))).alias("row"))
    rows = once.select("key", "row.path", *(f"row.{c}" for c in keep), F.posexplode("row.found").alias("at", "x"))
    # A candidate starts after what stood between, and in, those before it.
    so_far = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    length = F.char_length("x.candidate")
    start = F.sum(F.col("x.skipped") + length).over(so_far) - length
    return rows.select("key", "at", start.cast("int").alias("start"), "x.candidate", "x.before", "x.after", "path", *keep)


def with_keys(docs: DataFrame) -> DataFrame:
    """``key, doc_id, text, path``: the key is a hash of id and text, so that equal rows have equal findings."""
    text = F.coalesce(F.col("text"), F.lit(""))
    path = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        path.alias("path"),
    )


def sample_of(docs: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """``key, doc_id, text, path`` of at most ``max_texts`` different rows, chosen by hash, each once."""
    keyed = with_keys(docs)
    keys = saved(keyed.select(F.col("key").alias("doc_id")).distinct(), "secret-keys")
    chosen = bounded(keys, max_texts).select(F.col("doc_id").alias("key"))
    sample = saved(keyed.join(F.broadcast(chosen), "key").dropDuplicates(["key"]), "secret-sample")
    discard(keys)
    return sample


def frequent_words(docs: DataFrame, most: int = MAX_WORDS, min_texts: int = MIN_TEXTS) -> list[str]:
    """The words of four or more letters that most rows of ``docs`` have, at most ``most`` (ties: by letters).

    All rows are read; rows that are repeated count once. Only those are shuffled with their texts.
    """
    keyed = with_keys(docs).select("key", "text")
    repeated = saved(keyed.groupBy("key").count().filter("count > 1").select("key"), "secret-repeats")
    once = keyed.join(repeated, "key", "left_anti").unionByName(keyed.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    words = once.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("w"))
    counted = words.filter(F.char_length("w").between(4, 20)).groupBy("w").count().filter(F.col("count") >= min_texts)
    found = [r["w"] for r in counted.orderBy(F.desc("count"), "w").limit(most).collect()]
    discard(repeated)
    return found


def made_texts(sample: DataFrame) -> DataFrame:
    """``key, text, path, secret``: short texts of the sample's own hashes, numbers and words, in settings that tell
    whether they are a secret; ``secret`` is null where they are none."""
    words = F.filter(F.split(F.lower(F.col("text")), "[^a-z]+"), lambda w: F.char_length(w) > 3)
    own = sample.select(
        "key",
        "path",
        F.concat(words, F.array(*map(F.lit, ("some", "long", "words")))).alias("w"),
        F.sha1(F.col("text").cast("binary")).alias("h40"),
        F.sha2("text", 256).alias("h64"),
        F.md5(F.col("text").cast("binary")).alias("h32"),
        F.base64(F.unhex(F.sha2(F.concat("text", F.lit("x")), 256))).alias("b44"),
        F.lpad(F.abs(F.xxhash64("text")).cast("string"), 19, "7").alias("digits"),
    ).withColumn("letters", F.translate("h64", "0123456789", "qrstuvwxyz"))
    made = own.selectExpr(
        "key",
        "path",
        r"""stack(42,
          'api_key = "', h40, '"', 1,
          'token = "', upper(h40), '"', 1,
          'token = "', h40, '"', 1,
          concat(w[0], ' password: '), left(b44, 24), ' ', 1,
          'Authorization: Bearer ', left(b44, 40), '\n', 1,
          'export SECRET_TOKEN=', h64, ' ', 1,
          concat(w[1], ' '), concat('AKIA', upper(left(regexp_replace(b44, '[^A-Za-z0-9]', '7'), 16))), ' ', 1,
          concat(w[0], ' '), concat('ghp_', left(regexp_replace(b44, '[^A-Za-z0-9]', 'q'), 36)), ' ', 1,
          "client_secret: '", h32, "'", 1,
          'DB_PASSWORD=', left(h40, 20), '\n', 1,
          concat('https://', w[0], '.com/v1?api_key='), h40, '&page=2', 1,
          concat('http://', w[1], '.org/?access_key='), left(h64, 24), ' ', 1,
          'secret_key=', left(h40, 20), ' ', 1,
          concat(w[1], ' password: '), concat(left(w[0], 6), left(digits, 1), left(letters, 3)), ' ', 1,
          'password=', concat(left(letters, 5), right(digits, 3)), '\n', 1,
          'PASSWD=', replace(left(b44, 10), '=', '7'), '\n', 1,
          'api_key = "', left(letters, 26), '"', 1,
          'password = "', left(letters, 10), '"', 1,
          'auth_token: ', left(letters, 16), '\n', 1,
          'commit ', h40, ' ', 0,
          'commit=', h40, ' ', 0,
          'revision ', h40, '\n', 0,
          'sha256:', h64, ' ', 0,
          'sha256=', h64, ' ', 0,
          'etag="', h32, '"', 0,
          'md5 checksum ', h32, ' ', 0,
          concat(w[0], ' /static/css/'), h32, '.css', 0,
          concat('https://', w[0], '.org/news/'), concat_ws('-', '2021', w[0], w[1], w[2], 'article'), ' ', 0,
          'id: ', concat_ws('-', left(h64, 8), substr(h64, 9, 4), substr(h64, 13, 4), substr(h64, 17, 4), substr(h64, 21, 12)), ' ', 0,
          concat('see ', w[1], ' '), concat_ws('_', w[0], w[1], w[2], '2'), ' ', 0,
          'api_key = "', concat('your-', w[0], '-key-here-123'), '"', 0,
          'API_KEY=', 'YOUR_API_KEY', '\n', 0,
          'token = "', concat(repeat('x', 20), '1'), '"', 0,
          'password: ', repeat('*', 10), '\n', 0,
          'password: ', w[0], ' ', 0,
          'the secret: ', w[1], ' and', 0,
          'token = ', concat_ws('_', 'get', w[0], w[1]), '(request)', 0,
          'password: ', concat('https://', w[0], '.org/', w[1]), ' ', 0,
          concat(w[0], ' '), left(digits, 16), ' ', 0,
          'order ', digits, ' ', 0,
          concat('/list?page=2&order_id='), digits, ' ', 0,
          concat(w[2], ' '), concat(w[0], w[1], w[2], '2024'), '. ', 0)
          as (before, candidate, after, label)""",
    )
    text = F.concat("before", "candidate", "after")
    return made.select(
        F.xxhash64("key", text).alias("key"), text.alias("text"), "path", F.when(F.col("label") == 1, F.col("candidate")).alias("secret")
    )


def labelled_findings(docs: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """``candidate, before, after, path, label`` from a bounded sample of texts, for corpora without reviewed findings.

    Candidates of the sample count as secrets if a word for secrets assigns them and they are neither stand-ins nor
    common words; those without a digit that words cover in part have no label. Each text of the sample also gives
    ``made_texts``, whose candidates are found as those of any text, so that they have the shapes met in scanning.
    """
    sample = sample_of(docs, max_texts)
    return _labelled(sample, frequent_words(docs))


def _labelled(sample: DataFrame, words: Sequence[str]) -> DataFrame:
    c = F.col("candidate")
    assigned = F.col("before").rlike(f"(?i)({SECRET_WORDS})[\\w-]*\\s*[\"']?\\s*[:=]\\s*[\"']?$")
    worded = F.when(c.rlike("[0-9]"), 0.0).otherwise(coverage(c, words))
    label = (
        F.when(~assigned | c.rlike(f"(?i)({STAND_INS})") | (worded >= 0.9), 0.0).when(worded < 0.3, 1.0)
    )
    real = candidates(sample).withColumn("label", label)
    made = candidates(made_texts(sample), "secret").withColumn(
        "label", F.coalesce(c == F.col("secret"), F.lit(False)).cast("double")
    )
    columns = ["candidate", "before", "after", "path", "label"]
    return real.select(*columns).unionByName(made.select(*columns))


@dataclass
class Forest:
    """A fitted forest, None where its labels had fewer than two classes, and the words its dictionary has besides."""

    model: RandomForestClassificationModel | None
    words: Sequence[str] = ()


def forest(labelled: DataFrame, limit: int = MAX_LABELLED, words: Sequence[str] = ()) -> Forest:
    """The forest fitted on ``labelled``, whose labels are 0 or 1 (others are left out).

    ``limit`` bounds the rows, chosen by a hash of their content; they are fitted in one order, so that every run and
    partitioning grows the same trees.
    """
    shape = features(labelled.filter(F.col("label").isin(0, 1)), words)
    order = F.xxhash64("candidate", "before", "after", "label")
    rows = saved(shape.orderBy(order, "candidate", "before").limit(limit).select(*FEATURES, "label"), "findings")
    model = None
    if rows.select("label").distinct().count() == 2:
        ordered = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows).coalesce(1)
        ordered = ordered.sortWithinPartitions(*FEATURES, "label")
        model = RandomForestClassifier(
            featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED
        ).fit(ordered)
    discard(rows)
    return Forest(model, words)


def scored(found: DataFrame, fitted: Forest) -> DataFrame:
    """Candidates with ``score``, the forest's share for a secret; 1 without a model."""
    if fitted.model is None:
        return found.withColumn("score", F.lit(1.0))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(features(found, fitted.words))
    model = fitted.model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("probability")
    share = vector_to_array("probability")[1]
    return model.transform(rows).select(*found.columns, share.alias("score"))


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``key, doc_id, text, n_candidates, secrets`` for every row of ``docs``; ``text`` has MASK in place of secrets.

    ``secrets`` lists ``start``, ``length`` (code points of the given text) and ``score`` of each candidate at or above
    ``threshold``. ``labelled`` are reviewed findings (``candidate, before, after, path, label``); without, a bounded
    sample of ``docs`` gives them. The frequent words of the dictionary are those of all ``docs``. Null texts are empty
    and have no secrets; repeated rows have the same; an empty table gives no rows. Columns other than ``doc_id``,
    ``text`` and ``source`` (the path) are ignored.
    """
    keyed = with_keys(docs)
    sample = sample_of(docs)
    words = frequent_words(docs)
    fitted = forest(_labelled(sample, words) if labelled is None else labelled, words=words)
    discard(sample)
    found = candidates(keyed)
    found = scored(found, fitted).select("key", "at", "start", F.char_length("candidate").alias("length"), "score")
    lists = found.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("at", "start", "length", "score"))).alias("found")
    )
    hit = keyed.filter(F.col("text").rlike(CANDIDATE)).join(lists, "key")
    clean = keyed.filter(~F.col("text").rlike(CANDIDATE))
    between, hits = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    masked = F.zip_with(hits, "found", lambda h, f: F.when(f["score"] >= threshold, F.lit(MASK)).otherwise(h))
    text = F.array_join(F.flatten(F.zip_with(between, masked, lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")
    secrets = F.transform(
        F.filter("found", lambda f: f["score"] >= threshold), lambda f: F.struct(f["start"], f["length"], f["score"])
    )
    hit = hit.select("key", "doc_id", text.alias("text"), F.size("found").alias("n_candidates"), secrets.alias("secrets"))
    none = F.array().cast(hit.schema["secrets"].dataType)
    return hit.unionByName(clean.select("key", "doc_id", "text", F.lit(0).alias("n_candidates"), none.alias("secrets")))
