"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.bpe import encode_decode
from marginalia.llm.clustering import CENTROIDS, ROUNDS, clustered, with_inertia
from marginalia.llm.linededup import line_dedup
from marginalia.llm.mixing import BUDGET, mixed
from marginalia.llm.neardup import class_ids
from marginalia.llm.negatives import hard_negatives
from marginalia.llm.pii import BASE_KINDS as PII_KINDS
from marginalia.llm.pii import pii_spans
from marginalia.llm.quality import judged, statistics_table
from marginalia.llm.secrets import BASE_KINDS as SECRET_KINDS
from marginalia.llm.secrets import secret_spans
from marginalia.llm.sharding import LAW, sharded, size_of
from marginalia.llm.spans import digest_text
from marginalia.llm.suffixes import remove_repeats
from marginalia.llm.topk import top_k
from marginalia.llm.urls import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("""
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


#: Host, path and verdict of the rules that the URL query applies.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query("""
WITH rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC) AS n
  FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE n = 1
""")
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = judged(statistics_table(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in counts], "base_failed", "kept", "rule")


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ids(table(spark, sf_dir, "documents"))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"), budget=BUDGET)
    return rows.select(
        "doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"),
        F.round("probability", 9).alias("probability"), F.col("drawn").alias("kept"),
    )


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"),
    )


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _digests(rows: DataFrame, column: str, base: tuple[str, ...]) -> DataFrame:
    spans = F.col(column)
    known = F.filter(spans, lambda s: s["kind"].isin(*base))
    return rows.select(
        "doc_id",
        *[_number(spans, k).alias(f"n_{k}") for k in base],
        F.sha2(digest_text(known).cast("binary"), 256).alias("base_sha256"),
        digest_text(spans).alias("spans"),
    )


@query()
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text")), "pii", PII_KINDS)


@query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")), "secrets", SECRET_KINDS)


@query("""
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), fits AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def _cluster_sql() -> str:
    """One table of distances, assignments and means a round."""
    gap = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [f"""
vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (
    SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM vectors ORDER BY h, v LIMIT {CENTROIDS})
)"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
a{i} AS (
  SELECT v.vec_id, v.v, c.cluster, {gap} AS distance FROM vectors v, c{i} c
  QUALIFY row_number() OVER (PARTITION BY v.vec_id, v.v ORDER BY distance, c.cluster) = 1
)""")
        if i < ROUNDS:
            parts.append(f"""
m{i} AS (
  SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY d) AS c FROM (
    SELECT cluster, d, CAST(sum(v[d]) AS DOUBLE) AS s, count(*) AS n FROM a{i}, range(1, 65) t(d) GROUP BY ALL) GROUP BY cluster
), c{i + 1} AS (SELECT k.cluster, coalesce(m.c, k.c) AS c FROM c{i} k LEFT JOIN m{i} m USING (cluster))""")
    return "WITH" + ",".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


@query(_cluster_sql())
def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(table(spark, sf_dir, "embeddings")))


@query()
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("key"))
    rows = sharded(docs, F.col("size"), F.col("key"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
