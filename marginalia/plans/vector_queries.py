"""Registered queries: nearest neighbours, rank fusion, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import fulltext as ft
from marginalia.operators import retrieval as rt
from marginalia.plans import corpus
from marginalia.plans.fulltext_queries import _bm25_sql
from marginalia.plans.registry import query

_PROBE = 7
_DIST = f"""
dist AS (
  SELECT vec_id, 'doc-' || (vec_id // 3) AS node_id, 'doc-' || (vec_id // 3) || '#' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id,
    list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {_PROBE})) AS distance,
    list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {_PROBE})) AS cosine
  FROM embeddings
), shown AS (SELECT *, substr(coalesce(text, ''), 1, 200) AS excerpt FROM dist LEFT JOIN documents ON doc_id = vec_id // 3)"""


def _chunks(spark, sf_dir):
    """Each vector as a chunk; three neighbours in the table belong to one note, whose text they show."""
    texts = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    note = F.concat(F.lit("doc-"), F.floor(F.col("vec_id") / 3).cast("string"))
    number = F.lpad(F.col("vec_id").cast("string"), 9, "0")
    vectors = corpus.table(spark, sf_dir, "embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 3))
    return vectors.join(texts, "doc_id", "left").select(
        F.concat_ws("#", note, number).alias("id"), note.alias("node_id"),
        F.coalesce("text", F.lit("")).alias("content"), "embedding",
    )


def _probe(spark, sf_dir):
    row = corpus.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == _PROBE).select("embedding").first()
    return [float(x) for x in row["embedding"]]


@query(f"WITH {_DIST} SELECT id, round(distance, 6) AS distance, round(1 - distance, 6) AS score FROM dist")
def vector_distances(spark, sf_dir):
    rows = rt.distances(_chunks(spark, sf_dir), _probe(spark, sf_dir))
    return rows.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"""WITH {_DIST} SELECT id, round(distance, 6) AS distance, round(cosine, 6) AS cosine,
  coalesce(text, '') AS content FROM shown ORDER BY shown.distance, id LIMIT 20""")
def knn_l2(spark, sf_dir):
    rows = rt.knn(_chunks(spark, sf_dir), _probe(spark, sf_dir), 20)
    return rows.select("id", F.round("distance", 6).alias("distance"), F.round("cosine", 6).alias("cosine"), "content")


@query(f"""WITH {_DIST},
one AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY distance, id) AS n FROM shown)
SELECT node_id, id, round(1 - distance, 6) AS score, excerpt FROM one WHERE n = 1 ORDER BY distance, id LIMIT 25""")
def semantic_notes(spark, sf_dir):
    rows = rt.semantic(_chunks(spark, sf_dir), _probe(spark, sf_dir), 25)
    return rows.select("node_id", "id", F.round("score", 6).alias("score"), "excerpt")


@query(f"WITH {_DIST} SELECT node_id, id, round(1 - distance, 6) AS score, excerpt FROM shown ORDER BY distance, id LIMIT 25")
def semantic_chunks(spark, sf_dir):
    rows = rt.semantic(_chunks(spark, sf_dir), _probe(spark, sf_dir), 25, unique="chunks")
    return rows.select("node_id", "id", F.round("score", 6).alias("score"), "excerpt")


@query("""
WITH ranks AS (
  SELECT conv_id AS key, 0 AS list_no, turn + 1 AS rank FROM conversations
  UNION ALL SELECT doc_id, 1, quality * 2 + toxic + 1 FROM labels
)
SELECT key, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM ranks GROUP BY 1
""")
def rrf_fuse(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations").selectExpr("conv_id key", "0 list_no", "cast(turn + 1 as int) rank")
    marks = corpus.table(spark, sf_dir, "labels").selectExpr("doc_id key", "1 list_no", "quality * 2 + toxic + 1 rank")
    return rt.fuse(turns.unionByName(marks)).select("key", F.round("rrf", 6).alias("rrf"))


_WORDS = "eres things ing"
_LEXICAL = _bm25_sql("SELECT id, length, term AS phrase, col FROM tokens WHERE term IN ('er', 'thing', 'ing')", 3)
_LISTS = f"""
{_DIST}, lexical AS ({_LEXICAL.replace('round(', '(').replace('), 6) AS score', ')) AS score')}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY distance, id) AS n FROM dist),
near AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS rank FROM NEAREST ORDER BY distance, id LIMIT 80),
words AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, node_id) AS rank FROM lexical ORDER BY round(score, 12) DESC, node_id LIMIT 80),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY rank) AS n FROM near) WHERE n = 1)"""
_FUSED = """
fused AS (
  SELECT key, sum(1.0 / (60 + rank)) AS score, min(list_no * 1000 + rank) AS first,
         arg_min(node_id, list_no * 1000 + rank) AS node_id, arg_min(chunk_id, list_no * 1000 + rank) AS chunk_id
  FROM mentions GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 20
)
SELECT f.node_id, f.chunk_id, round(f.score, 6) AS score, round(1 - b.distance, 6) AS semantic_score,
       round(w.score, 6) AS lexical_score
FROM fused f LEFT JOIN best b ON b.node_id = f.node_id LEFT JOIN words w ON w.node_id = f.node_id"""


def _hybrid(spark, sf_dir, unique):
    rows = rt.hybrid(
        _chunks(spark, sf_dir), *ft.searchable(corpus.texts(spark, sf_dir), _WORDS),
        _probe(spark, sf_dir), _WORDS, 20, unique, 80,
    )
    return rows.select("node_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("score", "semantic_score", "lexical_score")])


@query(f"""WITH {_LISTS.replace('NEAREST', 'firsts WHERE n = 1')}, mentions AS (
  SELECT 0 AS list_no, row_number() OVER (ORDER BY rank) AS rank, node_id AS key, node_id, id AS chunk_id FROM best
  UNION ALL SELECT 1, rank, node_id, node_id, NULL FROM words
), {_FUSED}""")
def hybrid_notes(spark, sf_dir):
    return _hybrid(spark, sf_dir, "notes")


@query(f"""WITH {_LISTS.replace('NEAREST', 'dist')}, mentions AS (
  SELECT 0 AS list_no, rank, id AS key, node_id, id AS chunk_id FROM near
  UNION ALL
  SELECT 1, w.rank, coalesce(b.id, '_note_only::' || w.node_id), w.node_id, b.id
  FROM words w LEFT JOIN best b ON b.node_id = w.node_id
), {_FUSED}""")
def hybrid_chunks(spark, sf_dir):
    return _hybrid(spark, sf_dir, "chunks")
