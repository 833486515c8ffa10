"""The queries of the text operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statweave.llm import centroid_clusters, decontaminate, exact_dedup, fingerprints, language_model, lexical_search, lines, ngram_join, packing, sharding, token_counts, toxicity, training_order
from statweave.llm.common import scratch, table, text_of, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def fold(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def held_out(n: int) -> Column:
    return F.coalesce(fold(n) == 2, F.lit(False))


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = written(packing.cut(table(spark, folder, "documents")))
    return packing.pack(pieces)


CONTAINED = """
with w as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w
           from (select distinct item_id, text from benchmark)),
i as (select item_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) as g from w where len(w) > 0),
ig as (select item_id, len(g) as n, unnest(g) as g from i),
dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents),
dg as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda p: array_to_string(w[p:p + 4], ' ')))) as g from dw where len(w) > 0)
select doc_id, item_id, n::int as n_shingles, count(*)::int as n_shared, count(*) / n as containment
from dg join ig using (g) group by doc_id, item_id, n having count(*) >= 0.75 * n
"""


@query("op2_benchmark_decontamination", CONTAINED)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op4_token_output")
def token_output(spark: SparkSession, folder: str) -> DataFrame:
    return training_order.shards(table(spark, folder, "documents"), scratch(spark))


@query("op5_token_counts")
def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


@query("op6_lm_scoring")
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.score(table(spark, folder, "documents"), fold(7) != 2)
    return scored.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"), fold(4) != 2)
    scored = toxicity.score(documents.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op8_document_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare(table(spark, folder, "documents"))


@query("op9_sharding")
def sharded(spark: SparkSession, folder: str) -> DataFrame:
    size = (F.octet_length(text_of()) + 1).cast("long").alias("size")
    crc = F.crc32(text_of().cast("binary")).alias("text_crc32")
    rows = table(spark, folder, "documents").select("doc_id", "source", size, crc)
    placed = sharding.interleave(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op10_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


COPIES = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents),
g as (select text, min(doc_id) as keep_id, count(*) as group_size from t group by text)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256 from t join g using (text)
"""


@query("op12_exact_dedup", COPIES)
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents"))


_VECTORS = """
with kept as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('1:' || vec_id::varchar)) - 1 as c, v from kept qualify c < 16)"""
_ROUND = """,
a{i} as (select r, arg_min(c, (d, c)) as c, min(d) as d
         from (select x.r, k.c, list_sum(list_transform(list_zip(x.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept x, c{i} k) group by r)"""
_MOVE = """,
s{i} as (select c, j, floor(sum(v[j]) / count(*))::bigint as m from a{i} join kept using (r), range(1, 65) g(j) group by c, j),
c{n} as (select c, coalesce(moved.v, c{i}.v) as v from c{i} left join (select c, list(m order by j) as v from s{i} group by c) moved using (c))"""
CLUSTERED = (
    _VECTORS
    + "".join(_ROUND.format(i=i) + _MOVE.format(i=i, n=i + 1) for i in range(3))
    + _ROUND.format(i=3)
    + """
select vec_id, c::int as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
       sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join kept using (r) join c3 using (c)
"""
)


@query("op11_centroid_clustering", CLUSTERED)
def centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    assigned, centroids = centroid_clusters.cluster(table(spark, folder, "embeddings"))
    return centroid_clusters.summary(assigned, centroids)


RANKED = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
d as (select doc_id, w, len(w) as n from w where len(w) > 0),
s as (select count(*) as docs, sum(n)::bigint as words from d),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
p as (select doc_id, n, t, count(*) as tf from (select doc_id, n, unnest(w) as t from d) group by all),
f as (select t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as weight from p, s group by t),
r as (select item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))))::bigint as score
      from i join p using (t) join f using (t), s group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from r where score > 0 qualify rank <= 10
"""


@query("op13_ranked_lexical_search", RANKED)
def ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
