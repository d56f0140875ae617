"""The best notes by blocks equal those of a full scoring, and fewer postings are scored."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.config import ChunkerConfig
from marginalia.operators import blockmax
from marginalia.operators import fulltext as ft
from marginalia.operators.embedding import HashedEmbedder
from marginalia.operators.indexing import Index

NODES = "id string, title string, body string"


def corpus(n, seed=1):
    """Common words everywhere, a few notes that are short and full of them, copies, and notes without text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["red"] * rng.randint(0, 2) + ["green"] * rng.randint(0, 2) + [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 60))]
        rng.shuffle(words)
        rows.append((f"n{i}", f"Note {i}", " ".join(words)))
    rows += [(f"top{i}", "red green", "red green " * (3 + i % 4)) for i in range(12)]
    return rows + [("blank", "", None), ("empty", None, "")]


def whole(nodes, query, k):
    found = ft.top(ft.search(ft.build_postings(nodes), ft.build_stats(nodes), query), k)
    return [(r["node_id"], round(r["score"], 9)) for r in found.collect()]


@pytest.mark.parametrize("cells", [4, 16])
def test_top_words(spark, cells, monkeypatch):
    monkeypatch.setattr(blockmax, "CELL_NOTES", cells)
    monkeypatch.setattr(blockmax, "FIRST_CELLS", 4)
    nodes = spark.createDataFrame(corpus(600), NODES).cache()
    postings = blockmax.in_cells(ft.build_postings(nodes), 614).withColumn("segment", F.lit(0)).cache()
    tables = blockmax.blocks(postings).withColumn("segment", F.lit(0)).cache()
    stats = ft.build_stats(nodes)
    for query, k in (("red green", 5), ("red", 8), ("red red green", 3), ("green w17", 1000), ("nowhere red", 5)):
        found = blockmax.top_words(postings, tables, stats, blockmax.words_of(spark, query), k)
        got = [(r["node_id"], round(r["score"], 9)) for r in found.hits.orderBy(*ft.best_first()).collect()]
        assert got == whole(nodes, query, k), query
        if k == 5 and got:
            assert found.scored < 0.6 * found.postings


def test_words_only(spark):
    assert blockmax.words_of(spark, "Running fast") == ["run", "fast"]
    assert blockmax.words_of(spark, "run*") is None and blockmax.words_of(spark, "one-two") is None and blockmax.words_of(spark, " ") is None


def test_top_words_of_an_index(spark, tmp_path):
    """Notes that a later segment has replaced count neither as hits nor in the frequencies."""
    index, config = Index(spark, str(tmp_path / "i")), ChunkerConfig(400, 4, 5)

    def reindex(rows):
        nodes = spark.createDataFrame([(i, t or "", b or "") for i, t, b in rows], NODES)
        index.reindex(nodes.select(
            "id", F.lit(1).cast("bigint").alias("z_pk"), "title", F.lit("Work").alias("folder"), F.lit(1).cast("bigint").alias("modified_at"),
            F.lit(False).alias("locked"), F.lit(False).alias("pinned"), "body"), HashedEmbedder(4), config)
        return nodes

    rows = corpus(80)
    nodes = reindex(rows)
    assert [(r[0], round(r[1], 9)) for r in index.top_words(["red", "green"], 9).hits.orderBy(*ft.best_first()).collect()] == whole(nodes, "red green", 9)
    rows = [(i, t, "nothing to see" if i == "top3" else b) for i, t, b in rows if i != "top7"] + [("late", "red", "green red green")]
    nodes = reindex(rows)
    assert [(r[0], round(r[1], 9)) for r in index.top_words(["red", "green"], 9).hits.orderBy(*ft.best_first()).collect()] == whole(nodes, "red green", 9)
