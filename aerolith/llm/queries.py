"""The operators over their whole tables, with the SQL that states their results where SQL can."""

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolith.llm import chat_format
from aerolith.llm.centroid_clusters import centroid_clusters, digests as cluster_digests
from aerolith.llm.common import table
from aerolith.llm.exact_dedup import exact_dedup
from aerolith.llm.packing import pack
from aerolith.llm.periodic_runs import periodic_runs
from aerolith.llm.quality_classifier import quality_classifier
from aerolith.llm.quality_rules import quality_rules
from aerolith.llm.retrieval_packing import retrieval_pack
from aerolith.llm.secret_scan import secret_scan
from aerolith.llm.sentencepiece_fst import round_trip
from aerolith.llm.simhash import near_dedup
from aerolith.llm.substring_dedup import substring_dedup
from aerolith.llm.toxicity import toxicity


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


# A record of another layout than the table's whose texts are made of control strings.
MARKS = """{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"},
 {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.range(1).select(F.lit(-7).cast("long").alias("id"), F.lit(0).cast("long").alias("part"), F.parse_json(F.lit(MARKS)).alias("record"))
    records = chat_format.chat_rows(table(spark, sf_dir, "conversations")).unionByName(marks)
    return chat_format.digests(chat_format.formatted(chat_format.canonical_turns(records)))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets", F.sha2("text", 256).alias("masked_sha256")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_digests(centroid_clusters(table(spark, sf_dir, "embeddings")))


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten, by the crc32 of its id, repeats a stretch of its words up to its end; a null id never does."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _planted(batches):
    for b in batches:
        pairs = zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()))
        texts = [b" ".join(planted_words(i, (t.as_py() or b"").split())).decode() for i, t in pairs]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


# Of the runs in order of start and period, the first with the greatest length in periods, compared exactly.
_GREATEST = """reduce(runs, cast(null as struct<start:long,length:long,period:long>),
  (best, x) -> if(best is null or x.length * best.period > best.length * x.period, x, best))"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(docs.mapInArrow(_planted, "doc_id long, text string"), digest=True)
    line = "array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')"
    return found.withColumn("best", F.expr(_GREATEST)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(line), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_best_fit_packing,
        op3_quality_classifier,
        op4_sentencepiece,
        op5_substring_dedup,
        op6_exact_dedup,
        op7_quality_rules,
        op8_chat_format,
        op9_secret_scan,
        op10_toxicity,
        op11_retrieval_packing,
        op12_centroid_clustering,
        op13_periodic_runs,
    )
}

_CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)" + _CONTROL + r"', '\1\\\2\3', 'g')"



def _round_sql(i: int) -> str:
    """Assignment to the centroids of round ``i``, and the centroids that follow."""
    return f"""
a{i} as materialized (select rid, min(d * 8 + cluster) % 8 as cluster, min(d * 8 + cluster) // 8 as distance from (
  select rid, cluster, sum((x - c) * (x - c)) as d from k join c{i} using (j) group by rid, cluster) group by rid),
c{i + 1} as materialized (select cluster, j, coalesce(m.c, o.c) as c from c{i} o left join (
  select cluster, j, (s - ((s % n) + n) % n) // n as c from (
    select cluster, j, sum(x) as s, count(*) as n from k join a{i} using (rid) group by cluster, j)) m using (cluster, j)),"""


ORACLES = {
    "op12_centroid_clustering": f"""
with e as materialized (select row_number() over () as rid, vec_id, embedding from embeddings where len(embedding) = 64),
y as materialized (select rid, vec_id, generate_subscripts(embedding, 1) as j, unnest(embedding) as y from e),
ok as (select rid from y group by rid having count(y) = 64 and bool_and(isfinite(y))),
k as materialized (select y.rid, vec_id, j, cast(floor(1024 * cast(y as double)) as bigint) as x from y join ok using (rid)),
first as (select rid, row_number() over (order by sha256('3:' || vec_id), rid) - 1 as cluster
  from (select distinct rid, vec_id from k) qualify cluster < 8),
c0 as materialized (select cluster, j, x as c from k join first using (rid)),
{"".join(_round_sql(i) for i in range(10))}
{_round_sql(10).split("c11 as")[0].strip()}
inertia as (select cluster, sum(distance) as s from a10 group by cluster),
shown as (select cluster, sha256(string_agg(cast(cast(c as bigint) as varchar), ',' order by j)) as h from c10 group by cluster)
select e.vec_id, cast(a10.cluster as int) as cluster, cast(distance as bigint) as distance,
  cast(inertia.s as bigint) as cluster_inertia, cast((select sum(distance) from a10) as bigint) as inertia, h as centroid_sha256
from a10 join e using (rid) join inertia using (cluster) join shown using (cluster)
""",
    "op8_chat_format": f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
  select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '') as learned,
    sum(length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")})
        + length({_ESCAPED.format("text")}) + length('<|im_start|><|im_end|>') + 2) as chars
  from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, cast(length(learned) as bigint) as loss_chars,
  sha256(learned) as loss_sha256, cast(chars as bigint) as formatted_chars from o
""",
    "op6_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.t) as text_sha256 from n join g on n.t = g.t
""",
}
