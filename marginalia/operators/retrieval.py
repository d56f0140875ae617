"""Nearest chunks, rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import cosine_similarity, l2_distance
from marginalia.operators import fulltext
from marginalia.session import stored

RRF_K = 60
#: Places of either list that a hybrid search fuses.
HYBRID_DEPTH = 1000
EXCERPT_CHARS = 200
NOTE_ONLY = "_note_only::"
UNIQUE = ("notes", "chunks")


def distances(chunks: DataFrame, vector: Sequence[float], embedding: str = "embedding") -> DataFrame:
    """Add ``distance`` and ``score`` (one minus distance) to the chunks of the query's width."""
    rows = chunks.where(F.size(embedding) == len(vector))
    return rows.withColumn("distance", l2_distance(F.col(embedding), vector)).withColumn("score", 1 - F.col("distance"))


#: Reads the rows of a few chunks, given their ids and those of their notes.
Fetch = Callable[[list[str], list[str]], DataFrame]


def _page_of(chunks: DataFrame, near: DataFrame, vector: Sequence[float], fetch: Fetch | None = None) -> DataFrame:
    """The stored columns of the few chunks in ``near`` (id, distance, score), and their true cosine.

    With ``fetch`` they are read by key, which takes a column ``node_id``; the page itself passes through the driver.
    """
    if fetch is not None:
        near = held(near)
        keys = near.select("id", "node_id").collect()
        chunks = fetch([r["id"] for r in keys], [r["node_id"] for r in keys])
    rows = chunks.join(near.select("id", "distance", "score"), "id")
    shown = rows.withColumn("cosine", cosine_similarity(F.col("embedding"), vector)).drop("embedding")
    return shown.orderBy("distance", "id")


def knn(chunks: DataFrame, vector: Sequence[float], limit: int, offset: int = 0, fetch: Fetch | None = None) -> DataFrame:
    """The ``limit`` nearest chunks with their true cosine; ties go to the lower id.

    Only ids and vectors are read to find them; the other columns follow for the page alone.
    """
    keys = ["id"] if fetch is None else ["id", "node_id"]
    slim = distances(chunks.select(*keys, "embedding"), vector).drop("embedding")
    near = slim.orderBy("distance", "id").offset(offset).limit(limit)
    return _page_of(chunks, near, vector, fetch)


def nearest_notes(
    chunks: DataFrame, vector: Sequence[float], limit: int, offset: int = 0, fetch: Fetch | None = None
) -> DataFrame:
    """The ``limit`` nearest notes, each with its nearest chunk, among all chunks."""
    slim = distances(chunks.select("id", "node_id", "embedding"), vector).drop("embedding")
    best = slim.groupBy("node_id").agg(F.min(F.struct("distance", "id", "score")).alias("best")).select("node_id", "best.*")
    return _page_of(chunks, best.orderBy("distance", "id").offset(offset).limit(limit), vector, fetch)


def held(page: DataFrame) -> DataFrame:
    """A page already fetched: its limit bounds what passes through the driver."""
    return page.sparkSession.createDataFrame(page.collect(), page.schema)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Number a result list from 1. Only for lists cut by a limit: they fit one task."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_per_note(hits: DataFrame) -> DataFrame:
    """The best chunk of each note among the hits; the earlier of equals."""
    first = Window.partitionBy("node_id").orderBy(F.col("score").desc(), F.col("rank"))
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _checked(unique: str) -> None:
    if unique not in UNIQUE:
        raise ValueError(f"unique={unique!r}: results are unique by one of {', '.join(UNIQUE)}")


def semantic(
    chunks: DataFrame, vector: Sequence[float], limit: int, unique: str = "notes", offset: int = 0, fetch: Fetch | None = None
) -> DataFrame:
    """The nearest chunks, or the nearest notes by their nearest chunk; ``rank`` counts from 1 on every page."""
    _checked(unique)
    found = (nearest_notes if unique == "notes" else knn)(chunks, vector, limit, offset, fetch)
    hits = ranked(found, F.col("distance"), F.col("id"))
    return hits.withColumn("excerpt", F.substring("content", 1, EXCERPT_CHARS))


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``list_no, rank, key``.

    ``first`` tells where a key was mentioned first; it breaks ties and names the row that stands for
    the key.
    """
    return lists.groupBy("key").agg(
        F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"),
        F.min(F.struct("list_no", "rank")).alias("first"),
    )


def hybrid_lists(
    semantic_hits: DataFrame, lexical_hits: DataFrame, limit: int, unique: str = "notes", offset: int = 0
) -> DataFrame:
    """Fuse ranked chunks (``rank, id, node_id, score``) with ranked notes (``rank, node_id, score``).

    Both inputs are cut to the depth of the fusion; ``rank`` of the result is its place on the fused list.
    """
    _checked(unique)
    best = best_per_note(semantic_hits)
    if unique == "notes":
        near = ranked(best, F.col("rank")).withColumn("key", F.col("node_id"))
        words = lexical_hits.withColumn("key", F.col("node_id")).withColumn("chunk_id", F.lit(None).cast("string"))
    else:
        near = semantic_hits.withColumn("key", F.col("id"))
        own = best.select("node_id", F.col("id").alias("chunk_id"))
        words = lexical_hits.join(own, "node_id", "left").withColumn(
            "key", F.coalesce("chunk_id", F.concat(F.lit(NOTE_ONLY), F.col("node_id")))
        )
    mentions = near.select(F.lit(0).alias("list_no"), "rank", "key", "node_id", F.col("id").alias("chunk_id")).unionByName(
        words.select(F.lit(1).alias("list_no"), "rank", "key", "node_id", "chunk_id")
    )
    fused = mentions.groupBy("key").agg(
        F.sum(1 / (F.lit(float(RRF_K)) + F.col("rank"))).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("first"),
        F.min_by("node_id", F.struct("list_no", "rank")).alias("node_id"),
        F.min_by("chunk_id", F.struct("list_no", "rank")).alias("chunk_id"),
    )
    scores = best.select("node_id", F.col("score").alias("semantic_score"))
    lexical = lexical_hits.select("node_id", F.col("score").alias("lexical_score"))
    order = [F.col("score").desc(), F.col("first.list_no"), F.col("first.rank")]
    page = ranked(fused.orderBy(*order).offset(offset).limit(limit), *order)
    stamped = page.join(scores, "node_id", "left").join(lexical, "node_id", "left")
    return stamped.drop("key", "first")


def hybrid(
    chunks: DataFrame,
    postings: DataFrame,
    stats: DataFrame,
    vector: Sequence[float],
    query: str,
    limit: int,
    unique: str = "notes",
    depth: int = HYBRID_DEPTH,
    offset: int = 0,
) -> DataFrame:
    """Semantic and full-text results fused by rank, with the score of either source per note.

    ``depth`` is the number of places of each list that take part: notes of both lists, or chunks of the semantic one with
    ``unique="chunks"``. It does not depend on the page, so all pages are cut from one fused list; another depth may change the order.
    """
    near = stored(semantic(chunks, vector, depth, unique).select("rank", "id", "node_id", "score"), "near")
    found = stored(fulltext.top(fulltext.search(postings, stats, query), depth), "words")
    words = ranked(found, *fulltext.best_first())
    return hybrid_lists(near, words, limit, unique, offset)
