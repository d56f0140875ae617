"""The index in segments: what a pass writes, what readers see, and who wins."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.config import ChunkerConfig
from marginalia.operators import fulltext as ft
from marginalia.operators.embedding import HashedEmbedder
from marginalia.operators.indexing import Index
from marginalia.sources.snapshots import PassOvertaken, Snapshots
from marginalia.streaming.feed import change_feed, watch

CONFIG = ChunkerConfig(60, 4, 5)


def source(spark, rows):
    columns = "id string, z_pk bigint, title string, folder string, modified_at bigint, locked boolean, pinned boolean, body string"
    return spark.createDataFrame([(f"n{k}", k, t, folder, 1, False, False, body) for k, t, folder, body in rows], columns)


def notes(n):
    return [(k, f"Title {k}", "Work", f"Body of number {k}, with some words. Another sentence of {k}.") for k in range(n)]


def sizes(index):
    """Rows that the last pass wrote, by table."""
    tables = ("nodes", "chunks", "postings", "failed_chunks", "replaced", "changed", "attempts")
    return {t: index.store.read(t).count() for t in tables}


def state(index):
    return (
        sorted(map(str, index.nodes().collect())), sorted(map(str, index.chunks().collect())),
        sorted(map(str, index.postings().select("term", "node_id", "title_at", "body_at").collect())),
        tuple(map(str, index.stats().collect())))


def test_a_pass_writes_what_changed(spark, tmp_path):
    index, rows = Index(spark, str(tmp_path / "i")), notes(200)
    first = index.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    own = index.chunks().where("node_id = 'n17'").count()
    rows[17] = (17, "Title 17", "Work", "Nothing of the old text is left.")
    again = index.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    wrote = sizes(index)
    assert (wrote["nodes"], wrote["replaced"], wrote["changed"]) == (1, 3, 1) and wrote["chunks"] == wrote["attempts"] == again["chunks_embedded"] == 1
    assert wrote["postings"] < 20
    assert again["chunks_skipped"] == first["chunks_embedded"] - own and again["indexed"] == 200
    assert len(index.store.segments()) == 2
    # Deleted, renamed and new notes, then the same state indexed at once.
    rows = [(k, "Other title" if k == 3 else t, f, b) for k, t, f, b in rows if k != 5] + [(900, "New", "Work", "New body text.")]
    third = index.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    assert (third["deleted"], sizes(index)["nodes"]) == (1, 2)
    whole = Index(spark, str(tmp_path / "whole"))
    whole.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    assert state(index) == state(whole)
    index.compact()
    assert len(index.store.segments()) == 1 and state(index) == state(whole)
    assert {r["node_id"] for r in ft.search(index.postings(), index.stats(), "nothing").collect()} == {"n17"}


def test_segments_are_folded_when_there_are_many(spark, tmp_path):
    index, rows = Index(spark, str(tmp_path / "i"), max_segments=2), notes(5)
    for turn in range(3):
        rows[turn] = (turn, f"Turn {turn}", "Work", f"Text of turn {turn}.")
        index.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    assert len(index.store.segments()) == 1 and index.store.current() == 4
    assert sorted(r["title"] for r in index.nodes().collect()) == sorted(t for _, t, _, _ in rows)


def test_a_moved_note(spark, tmp_path):
    """The stand-in chunk of a note without text names its folder; other notes change their row only."""
    index = Index(spark, str(tmp_path / "i"))
    rows = [(1, "Bare", "Old", ""), (2, "Full", "Old", "Text of its own.")]
    index.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    moved = [(k, t, "New", b) for k, t, _, b in rows]
    again = index.reindex(source(spark, moved), HashedEmbedder(8), CONFIG)
    assert (again["chunks_embedded"], again["chunks_skipped"]) == (1, 1)
    assert {r["folder"] for r in index.nodes().collect()} == {"New"}
    assert {r["id"]: r["content"] for r in index.chunks().collect()}["n1#0"] == "Bare\nfolder: New"


def test_vectors_follow_their_text(spark, tmp_path):
    """A paragraph put in front moves all later chunks; only what is new is embedded."""
    index = Index(spark, str(tmp_path / "i"))
    body = "".join(f"# Part {i}\n\nSentences of part number {i} go here.\n\n" for i in range(6))
    first = index.reindex(source(spark, [(1, "Long", "Work", body)]), HashedEmbedder(8), CONFIG)
    before = {r["content"]: r["embedding"] for r in index.chunks().collect()}
    again = index.reindex(source(spark, [(1, "Long", "Work", "# Fresh\n\nAn opening that was not there.\n\n" + body)]), HashedEmbedder(8), CONFIG)
    after = {r["content"]: r["embedding"] for r in index.chunks().collect()}
    assert again["chunks_embedded"] == 1 and again["chunks_skipped"] == first["chunks_embedded"]
    assert len(after) == len(before) + 1 and all(after[c] == v for c, v in before.items())


def test_force_embeds_all_again(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.reindex(source(spark, notes(3)), HashedEmbedder(8), CONFIG)
    forced = index.reindex(source(spark, notes(3)), HashedEmbedder(8), CONFIG, force=True)
    assert forced["chunks_skipped"] == 0 and forced["chunks_embedded"] > 0 and len(index.store.segments()) == 1


def test_of_two_passes_one_is_told(spark, tmp_path):
    """Even where both have found their number free, one file of that name is made."""
    root = str(tmp_path / "s")
    one, two = Snapshots(spark, root), Snapshots(spark, root)
    version = one.begin()
    assert two.begin() == version
    for store in (one, two):
        store.write(spark.range(1), version, "t")
    two.current = lambda: None
    one.publish(version)
    with pytest.raises(PassOvertaken):
        two.publish(version)
    assert Snapshots(spark, root).segments() == [one._begun[version]]
    assert len([f for f in os.listdir(f"{root}/manifest") if f.endswith(".json")]) == 1


def test_a_feed_of_notes_compares_these_alone(spark, tmp_path):
    feed, index, rows = str(tmp_path / "feed"), Index(spark, str(tmp_path / "i")), notes(6)

    def drain(changes):
        spark.createDataFrame(changes, schema.CHANGES).write.mode("append").parquet(feed)
        watch(change_feed(spark, feed), lambda: source(spark, rows), index, HashedEmbedder(8), str(tmp_path / "c"), CONFIG, keyed=True).awaitTermination()

    drain([(12, 0, 1)])
    assert index.nodes().count() == 6
    rows[1], rows[2] = (1, "Changed", "Work", "Another text."), (2, "Changed too", "Work", "Not in the feed.")
    del rows[4]
    drain([(12, 1, 1), (12, 4, 2)])
    titles = {r["id"]: r["title"] for r in index.nodes().collect()}
    assert titles["n1"] == "Changed" and titles["n2"] == "Title 2" and "n4" not in titles
    drain([(15, 3, 1)])
    assert {r["id"]: r["title"] for r in index.nodes().where(F.col("id") == "n2").collect()} == {"n2": "Changed too"}


def test_few_rows_are_read_from_few_files(spark, tmp_path):
    index, rows = Index(spark, str(tmp_path / "i"), rows_per_file=10), notes(300)
    index.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    rows = [(k, t, f, "Another text." if k == 17 else b) for k, t, f, b in rows if k != 30]
    index.reindex(source(spark, rows), HashedEmbedder(8), CONFIG)
    index = index.pinned()
    asked = [f"n{k}" for k in (17, 30, 31, 150, 299, 9999)]
    found = sorted(map(str, index.few_nodes(asked).collect()))
    assert found == sorted(map(str, index.nodes().where(F.col("id").isin(asked)).collect())) and len(found) == 4
    chunks = [r["id"] for r in index.store.each("chunks", schema.CHUNKS).where(F.col("node_id").isin(asked)).select("id").collect()]
    few = sorted(map(str, index.few_chunks(chunks, asked).collect()))
    assert few == sorted(map(str, index.chunks().where(F.col("node_id").isin(asked)).collect())) and few
    first, second = index.store.segments(index.version)
    whole = [f for f in os.listdir(f"{index.root}/{first}/nodes") if f.endswith(".parquet")]
    files = index.store.files_of(first, "nodes", "id", asked)
    assert 1 <= len(files) <= len(asked) and len(whole) >= 30
    # Nothing of the second segment is opened for notes that it does not hold.
    assert index.store.files_of(second, "nodes", "id", ["n299"]) == [] and index.few_nodes([]).collect() == []
