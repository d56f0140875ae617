"""The best notes for a query of words without scoring all that match.

Notes are dealt into cells by a hash of their id. The postings of a term in one cell are a block, of which the number of notes, the largest
weighted frequency and the least length are kept: BM25 grows with the one and falls with the other, so both bound what any
note of the block can score. Blocks of all words of a query meet by cell. A cell without one of the words has no hit; the others are
scored in order of their bounds, until no bound reaches the last place of what has been found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import fulltext as ft
from marginalia.session import stored

#: Notes of a cell, about.
CELL_NOTES = 64
#: Cells that are scored first, and how many times as many if these hold too few hits.
FIRST_CELLS, GROWTH = 32, 4
#: Share by which a bound is raised, for rounding.
ROOM = 1e-9
SCHEMA = "segment int, cell bigint, term string, notes bigint, most double, shortest int"


@dataclass
class Found:
    """Hits, best first, and how many of the query's posting rows were scored to find them."""

    hits: DataFrame
    scored: int
    postings: int


def in_cells(postings: DataFrame, notes: int) -> DataFrame:
    """Postings with the ``cell`` of their note; ``notes`` is the number of notes they are of."""
    return postings.withColumn("cell", F.pmod(F.xxhash64("node_id"), F.lit(max(1, notes // CELL_NOTES))).cast("bigint"))


def weight() -> Column:
    """Weighted frequency of a posting."""
    return F.size("title_at") * ft.TITLE_WEIGHT + F.size("body_at") * ft.BODY_WEIGHT


def blocks(postings: DataFrame) -> DataFrame:
    """``cell, term, notes, most, shortest`` of the postings of each cell and term."""
    return postings.groupBy("cell", "term").agg(
        F.count("*").alias("notes"), F.max(weight()).cast("double").alias("most"), F.min("length").alias("shortest"))


def words_of(spark, query: str) -> list[str] | None:
    """The distinct terms of a query of single whole words, with repeats; None for other queries."""
    phrases = ft.parse_query(spark, query)
    if not phrases or any(len(p.terms) > 1 or p.prefix for p in phrases):
        return None
    return [p.terms[0] for p in phrases]


def top_words(postings: DataFrame, block_table: DataFrame, stats: DataFrame, terms: list[str], k: int, hits: DataFrame | None = None) -> Found:
    """The ``k`` best notes that hold all ``terms``, as :func:`fulltext.top` of :func:`fulltext.search` gives them.

    ``postings`` has segment, cell, term, node_id, length, title_at and body_at, ``block_table`` what :func:`blocks` makes of each segment.
    ``hits`` (term, hits) gives document frequencies where blocks also count notes that no longer are; the bounds hold all the same.
    """
    spark = postings.sparkSession
    wanted = block_table.where(F.col("term").isin(terms))
    times = {t: terms.count(t) for t in terms}
    frequencies = {r["term"]: r["hits"] for r in (hits if hits is not None else wanted.groupBy("term").agg(F.sum("notes").alias("hits"))).collect()}
    none = spark.createDataFrame([], "node_id string, score double")
    if any(not frequencies.get(t) for t in terms):
        return Found(none, 0, 0)
    corpus = stats.first()
    notes, mean = corpus["notes"], corpus["mean_length"]

    def idf(t: str) -> Column:
        raw = F.log(F.lit((notes - frequencies[t] + 0.5) / (frequencies[t] + 0.5)))
        return F.when(raw > 0, raw).otherwise(F.lit(ft.LEAST_IDF)) * times[t]

    factor = F.lit(None)
    for t in times:
        factor = F.when(F.col("term") == t, idf(t)).otherwise(factor)

    def part(f: Column, length: Column) -> Column:
        return factor * f * (ft.K1 + 1) / (f + ft.K1 * (1 - ft.B + ft.B * length / mean))

    cells = stored(
        wanted.groupBy("segment", "cell").agg(
            F.count("*").alias("terms"), F.sum("notes").alias("rows"), (F.sum(part(F.col("most"), F.col("shortest"))) * (1 + ROOM)).alias("bound"))
        .where(F.col("terms") == len(times)).drop("terms"), "cells")
    own = postings.where(F.col("term").isin(list(times)))

    def scores(of: DataFrame) -> DataFrame:
        found = own.join(of.select("segment", "cell"), ["segment", "cell"], "left_semi").groupBy("node_id").agg(
            F.sum(part(weight().cast("double"), F.col("length"))).alias("score"), F.count("*").alias("present"))
        return found.where(F.col("present") == len(times)).select("node_id", "score")

    def place(of: DataFrame) -> float | None:
        """Score at the k-th place, as hits are compared."""
        last = of.orderBy(*ft.best_first()).offset(k - 1).limit(1).select(F.round("score", 12).alias("score")).first()
        return last["score"] if last else None

    # The cells of the highest bounds, more of them until they hold k hits, give a bar; what reaches it is scored in one go.
    take, bar, best = FIRST_CELLS, None, none
    while bar is None:
        done = stored(cells.orderBy(F.desc("bound"), "segment", "cell").limit(take), "done")
        best = stored(ft.top(scores(done), k), "best")
        bar = place(best)
        if done.count() < take:
            break
        take *= GROWTH
    rest = cells.join(done.select("segment", "cell"), ["segment", "cell"], "left_anti")
    rest = stored(rest.where(F.round("bound", 12) >= F.lit(bar)), "rest") if bar is not None else done.limit(0)
    best = stored(ft.top(best.unionByName(scores(rest)), k), "best")
    read = done.unionByName(rest).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return Found(best, read, sum(frequencies.values()))
