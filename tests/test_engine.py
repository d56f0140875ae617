"""Catalog, search, index, streams and edits over small fixtures."""

from __future__ import annotations

import gzip
import random
import sqlite3
import sys
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_functions import note_blob

from marginalia import schema
from marginalia.config import ChunkerConfig, EngineConfig
from marginalia.operators import catalog as cat
from marginalia.operators import fulltext as ft
from marginalia.operators import overlays as ov
from marginalia.operators import retrieval as rt
from marginalia.operators import mutations
from marginalia.operators.embedding import EmbedderDead, HashedEmbedder, embed, embed_query
from marginalia.operators.indexing import DimensionMismatch, Index
from marginalia.plans.api import LOCKED_BODY, NotesEngine
from marginalia.sources import notestore, sqlite_store
from marginalia.streaming.feed import change_feed, watch
from marginalia.sources.snapshots import PassOvertaken, Snapshots
from marginalia.streaming.overlay_state import live_overlays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def folder(pk, name, parent=None, kind=0, fid=None, marked=False, record=True, fetch=False, shared=False):
    return (pk, fid or f"F-{pk}", name, parent, kind, None, marked, record, fetch, shared)


def note(pk, title, home, body, day=1, locked=False, shared=False, owner=None, marked=False):
    when = datetime(2024, 1, day, tzinfo=timezone.utc)
    return (pk, f"N-{pk}", title, home, when, marked, False, locked, shared, owner, body)


FOLDERS = [
    folder(1, "Notes", fid="DefaultFolder-x"), folder(2, "Work"), folder(3, "Plans", 2), folder(4, "Bin", kind=1),
    folder(5, "Old", marked=True), folder(6, "Ghost", record=False, fetch=True), folder(7, "Orphan", 99),
    folder(8, "LoopA", 9), folder(9, "LoopB", 8), folder(10, "Team", shared=True),
]
NOTES = [
    note(1, "Budget", 2, "The budget for spring.\nNumbers and totals", 5),
    note(2, "Roadmap", 3, "Spring roadmap with budget lines", 4),
    note(3, "Secret", 2, "budget hidden", 3, locked=True),
    note(4, "Trashed", 4, "budget gone", 2),
    note(5, "Gone", 5, "budget in a dead folder", 2),
    note(6, "Shared", 1, "ours", 1, shared=True),
    note(7, "Theirs", 1, "theirs", 1, shared=True, owner="someone"),
    note(8, "Homeless", None, "budget nowhere", 1),
]


@pytest.fixture
def engine(spark, tmp_path):
    return NotesEngine(
        spark, spark.createDataFrame(NOTES, schema.NOTES), spark.createDataFrame(FOLDERS, schema.FOLDERS),
        attachments=spark.createDataFrame([(2,), (2,)], "note_pk bigint"),
        config=EngineConfig(index_root=str(tmp_path / "index"), chunker=ChunkerConfig(200, 4, 5)), embedder=HashedEmbedder(32),
        clock=lambda: NOW,
    )


# -- catalog -------------------------------------------------------------------


def test_folder_tree(spark, engine):
    listed = {f["name"]: f for f in engine.list_folders(include_counts=True)}
    assert listed["Plans"]["path"] == "Work/Plans" and listed["Orphan"]["path"] == "Orphan"
    assert listed["Work"]["note_count"] == 2 and listed["LoopA"]["path"] is None
    assert not {"Old", "Ghost", "Bin"} & set(listed)
    assert "Bin" in {f["name"] for f in engine.list_folders(include_trash=True)}
    visible = cat.visible_folders(engine.folders)
    stuck = cat.cyclic_folders(visible, cat.folder_paths(visible))
    assert {r["name"] for r in stuck.collect()} == {"LoopA", "LoopB"}
    assert cat.default_folder(engine.folders).first()["pk"] == 1


def test_change_log_hides_unconfirmed_folders(spark, engine):
    log = spark.createDataFrame([(15, 2, 2), (15, 11, 2), (12, 1, 2)], schema.CHANGES)
    folders = engine.folders.union(spark.createDataFrame([folder(11, "Local", record=False)], schema.FOLDERS))
    names = {r["name"] for r in cat.live_folders(folders, log).collect()}
    assert "Work" in names and "Local" not in names


def test_pages_partition_the_listing(engine):
    whole = [n["id"] for n in engine.list_notes(limit=500).results]
    assert whole == ["p1", "p2", "p3", "p6", "p7"]
    seen, cursor = [], None
    while True:
        page = engine.list_notes(limit=2, cursor=cursor)
        assert page.total_estimate == 5
        seen += [n["id"] for n in page.results]
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert seen == whole and cursor is None


def test_scopes_and_ranges(engine):
    assert [n["id"] for n in engine.list_notes("/work/").results] == ["p1", "p2", "p3"]
    assert [n["id"] for n in engine.list_notes("Bin").results] == ["p4"]
    assert [n["id"] for n in engine.list_notes(modified_after="2024-01-04", modified_before="2024-01-05").results] == ["p1", "p2"]
    for bad in ("nope", "/"):
        with pytest.raises(ValueError, match="unknown folder"):
            engine.list_notes(bad)
    assert [n["id"] for n in engine.recent(2)] == ["p1", "p2"]


# -- lexical search ----------------------------------------------------------------


def test_search(engine):
    page = engine.search_notes("BUDGET", include_body=True, max_body_chars=10)
    assert [(r["id"], r["match_count"]) for r in page.results] == [("p1", 2), ("p2", 1)]
    assert page.results[0]["snippets"] == ["The budget for spring. Numbers and totals"]
    assert page.results[0]["body_preview"] == "The budget"
    assert [r["id"] for r in engine.search_notes("secret").results] == ["p3"]
    assert engine.search_notes("secret").results[0]["snippets"][0].startswith("[locked")
    assert [r["id"] for r in engine.search_notes(r"road\w+", mode="regex").results] == ["p2"]
    assert [r["id"] for r in engine.search_notes("spring totals missing", fuzzy=True).results] == []
    assert [r["id"] for r in engine.search_notes("spring totals", fuzzy=True).results] == ["p1", "p2"]
    assert engine.search_notes("  ").results == [] and engine.search_notes("a", fuzzy=True).results == []
    first = engine.search_notes("budget", limit=1)
    assert first.has_more and [r["id"] for r in engine.search_notes("budget", limit=1, cursor=first.next_cursor).results] == ["p2"]
    with pytest.raises(ValueError, match="invalid mode"):
        engine.search_notes("x", mode="phrase")


def test_get_note(engine):
    assert engine.get_note("p1")["folder"] == "Work"
    assert engine.get_note("p3")["body"] == LOCKED_BODY
    assert engine.get_note("p2")["attachments"] == 2
    batch = engine.get_note(["p1", "f1", "p999"], format="text", fast=True)
    assert [b.get("action") for b in batch] == [None, "skipped", "skipped"]
    with pytest.raises(ValueError):
        engine.get_note("p999")
    assert len(engine.get_note(["p1"] * 30)) == 30
    assert engine.get_note("p1", format="html")["body"].startswith("<div>The budget")
    with pytest.raises(ValueError, match="unknown format"):
        engine.get_note("p1", format="pdf")


# -- full text ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    vocabulary = "run running runs café cafes note notes plan plans the of river rivers connected connection alpha beta".split()
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        body = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", ": "]) for w in words)
        rows.append((f"n{i:02}", " ".join(rng.choices(vocabulary, k=3)), body))
    return spark.createDataFrame(rows, "id string, title string, body string").cache(), rows


@pytest.mark.parametrize("query", ["running", "cafe plan", "river connecting", "conn*", '"the of"', "note-plan", "alpha beta gamma", "of the river run"])
def test_fulltext_matches_sqlite(spark, corpus, query):
    frame, rows = corpus
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(title, content, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, title, content) VALUES (?, ?, ?)", [(i, t, b) for i, (_, t, b) in enumerate(rows)])
    sql = "SELECT rowid, -bm25(f, 5.0, 1.0), snippet(f, 1, '>>>', '<<<', '...', 40) FROM f WHERE f MATCH ?"
    expected = {rows[i][0]: (s, x) for i, s, x in con.execute(sql, (ft.escape_query(query),))}
    found = ft.search(ft.postings_for(frame, query), ft.build_stats(frame), query)
    got = {r["node_id"]: (r["score"], r["excerpt"]) for r in ft.with_excerpts(found, frame, query, 100).collect()} if expected else {}
    assert set(got) == set(expected) and (expected or found.isEmpty())
    for key, (score, excerpt) in expected.items():
        assert got[key][0] == pytest.approx(score, rel=1e-9)
        assert got[key][1] == excerpt


@pytest.mark.parametrize("raw, escaped", [
    ("", ""), ("plain words", "plain words"), ("pre*", "pre*"), ("foo-bar", '"foo-bar"'), ("a AND b", '"a AND b"'),
    ('say "hi"', '"say ""hi"""'), ("ANDROID", "ANDROID"), ("x OR", '"x OR"'),
])
def test_escape(raw, escaped):
    assert ft.escape_query(raw) == escaped


def test_stray_star_finds_nothing(spark, corpus):
    assert ft.search(ft.build_postings(corpus[0]), ft.build_stats(corpus[0]), "* note").isEmpty()


# -- vectors and fusion ------------------------------------------------------------


def test_knn_order(spark):
    unit = 2**-0.5
    chunks = spark.createDataFrame(
        [("A", "a", "A", [1.0, 0.0, 0.0]), ("B", "b", "B", [0.0, 1.0, 0.0]), ("C", "c", "C", [unit, unit, 0.0]), ("D", "d", "D", [1.0])],
        "id string, node_id string, content string, embedding array<float>",
    )
    rows = rt.knn(chunks, [1.0, 0.0, 0.0], 5).collect()
    assert [r["id"] for r in rows] == ["A", "C", "B"]
    assert rows[0]["score"] == 1.0 and rows[2]["distance"] == pytest.approx(2**0.5) and rows[1]["cosine"] == pytest.approx(unit)


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c")], "list_no int, rank int, key string")
    got = {r["key"]: r["rrf"] for r in rt.fuse(lists).collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["a"] == pytest.approx(1 / 61) and got["b"] > got["a"] > got["c"]


@pytest.mark.parametrize("unique", ["notes", "chunks"])
def test_hybrid_lists(spark, unique):
    near = spark.createDataFrame([(1, "x#0", "x", 0.9), (2, "y#0", "y", 0.8), (3, "x#1", "x", 0.7)], "rank int, id string, node_id string, score double")
    words = spark.createDataFrame([(1, "z", 5.0), (2, "x", 4.0)], "rank int, node_id string, score double")
    rows = rt.hybrid_lists(near, words, 10, unique).collect()
    best = max(rows, key=lambda r: r["score"])
    assert (best["node_id"], best["chunk_id"], best["semantic_score"], best["lexical_score"]) == ("x", "x#0", 0.9, 4.0)
    assert len(rows) == (3 if unique == "notes" else 4)
    only = next(r for r in rows if r["node_id"] == "z")
    assert only["chunk_id"] is None and only["semantic_score"] is None
    with pytest.raises(ValueError):
        rt.hybrid_lists(near, words, 10, "pages")


# -- index -------------------------------------------------------------------------


def source(spark, rows):
    columns = "id string, z_pk bigint, title string, folder string, modified_at bigint, locked boolean, pinned boolean, body string"
    return spark.createDataFrame([(f"n{k}", k, t, "Work", 1, locked, False, b) for k, t, b, locked in rows], columns)


@dataclass(frozen=True)
class Picky(HashedEmbedder):
    """Refuses texts with the word bad, and dies on the word dead."""

    identity: str = "picky"

    def open(self):
        inner = super().open()

        def run(texts):
            if any("dead" in t for t in texts):
                raise EmbedderDead("gone")
            if any("bad" in t for t in texts):
                raise RuntimeError("bad text")
            return inner(texts)

        return run


def test_index_passes(spark, tmp_path):
    index, config = Index(spark, str(tmp_path / "i")), ChunkerConfig(60, 4, 5)
    embedder = Picky(16, max_chars=200)
    rows = [(1, "One", "Alpha text here. Beta text there. Gamma text everywhere. Delta.", False), (2, "Two", "", False),
            (3, "Three", "locked words", True), (4, "Four", "a bad body", False), (5, "Five", "y" * 59, False)]
    first = index.reindex(source(spark, rows), embedder, config)
    assert (first["indexed"], first["skipped"], first["chunks_failed"], first["chunks_skipped"]) == (4, 1, 1, 0)
    assert [tuple(r) for r in first["failures"].collect()] == [("n4#0", "embed-error", "bad text")]
    chunks = {r["id"]: r for r in index.chunks().collect()}
    assert chunks["n2#0"]["content"] == "Two\nfolder: Work" and "n4#0" not in chunks and "n3#0" not in chunks
    assert {r["reason"] for r in index.failed().collect()} == {"locked", "embed-error"}

    again = index.reindex(source(spark, rows), embedder, config)
    assert (again["chunks_embedded"], again["chunks_failed"]) == (0, 1)
    assert again["chunks_skipped"] == first["chunks_embedded"]

    edited = [rows[0], (2, "Two", "now with text", False), (4, "Four", "a good body", False), (5, "Five", "y" * 59, True)]
    third = index.reindex(source(spark, edited), embedder, config)
    assert (third["deleted"], third["chunks_embedded"], third["chunks_failed"]) == (1, 2, 0)
    assert {r["chunk_id"]: r["reason"] for r in index.failed().collect()} == {"n3#0": "locked", "n5#0": "locked"}
    status = index.status()
    assert status["nodes"] == 4 and status["dim"] == 16 and status["last_indexed_at"]
    words = ft.search(index.postings(), index.stats(), "text")
    assert {r["node_id"] for r in words.collect()} == {"n1", "n2"}

    with pytest.raises(DimensionMismatch):
        index.reindex(source(spark, edited), Picky(8), config)
    version = index.store.current()
    with pytest.raises(Exception, match="gone"):
        index.reindex(source(spark, [(1, "One", "dead text", False)]), embedder, config)
    assert index.store.current() == version and index.status()["nodes"] == 4
    swapped = index.reindex(source(spark, edited), replace(embedder, identity="other"), config)
    assert swapped["chunks_skipped"] == 0 and swapped["chunks_embedded"] > 0


def test_embed_reports_long_texts(spark):
    rows = spark.createDataFrame([("short",), ("x" * 50,)], "t string").select(embed(F.col("t"), HashedEmbedder(8, max_chars=10)).alias("r"))
    got = sorted(rows.collect(), key=lambda r: r["r"]["reason"] or "")
    assert sum(x * x for x in got[0]["r"]["vector"]) == pytest.approx(1, abs=1e-5)
    assert got[1]["r"]["reason"] == "too-long" and got[1]["r"]["vector"] is None


def test_engine_semantic(engine):
    with pytest.raises(ValueError):
        NotesEngine(engine.spark, engine.notes, engine.folders).index
    stats = engine.reindex_semantic()
    assert stats["indexed"] == 4 and stats["skipped"] == 1
    exact = "Spring roadmap with budget lines"
    page = engine.semantic_search(exact, limit=2)
    assert page.results[0]["id"] == "N-2" and page.results[0]["score"] == pytest.approx(1.0, abs=1e-3)
    fused = engine.hybrid_search("spring budget", limit=3)
    assert {"N-1", "N-2"} <= {r["id"] for r in fused.results}
    assert engine.hybrid_search("spring", unique="chunks").results
    words = engine.fulltext_search("budget").results
    assert words[0]["node_id"] == "N-1" and ">>>budget<<<" in words[0]["excerpt"]
    assert engine.semantic_search(" ").total_estimate == 0
    assert len(embed_query(engine.embedder, "q")) == 32


# -- overlays and streams ------------------------------------------------------------


def test_overlays(spark, engine):
    late, past = NOW + timedelta(seconds=30), NOW - timedelta(seconds=1)
    engine.overlay = spark.createDataFrame(
        [("renamed", 2, "Job", late), ("removed", 7, None, late), ("removed", 10, None, past), ("count", 2, "3", past), ("count", 2, "-1", late)],
        ov.SCHEMA,
    )
    listed = {f["id"]: f["path"] for f in engine.list_folders()}
    assert listed["f2"] == "Job" and listed["f3"] == "Job/Plans" and "f7" not in listed and "f10" in listed
    assert [n["id"] for n in engine.list_notes("job/plans").results] == ["p2"]
    assert [tuple(r) for r in ov.count_deltas(engine.overlay, NOW).collect()] == [(2, 2)]


def test_watch_reindexes_on_change(spark, tmp_path):
    feed, index = str(tmp_path / "feed"), Index(spark, str(tmp_path / "i"))
    log = spark.createDataFrame([(12, 1, 1)], schema.CHANGES)
    log.write.parquet(feed)
    state = {"rows": [(1, "One", "first body text", False)]}

    def drain():
        query = watch(change_feed(spark, feed), lambda: source(spark, state["rows"]), index, HashedEmbedder(8), str(tmp_path / "c"))
        query.awaitTermination()

    drain()
    assert index.store.current() == 1
    drain()
    assert index.store.current() == 1
    state["rows"].append((2, "Two", "second body text", False))
    log.write.mode("append").parquet(feed)
    drain()
    assert index.store.current() == 2 and index.nodes().count() == 2


def test_overlay_state_expires(spark, tmp_path):
    def event(kind, key, value, second):
        return (kind, key, value, NOW + timedelta(seconds=second))

    columns, path = "kind string, key bigint, value string, at timestamp", str(tmp_path / "e")
    batches = [[event("renamed", 1, "A", 0), event("count", 2, "1", 0), event("count", 2, "2", 1)], [event("removed", 3, None, 100)], [event("removed", 4, None, 300)]]
    out = []
    for rows in batches:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(path)
        stream = live_overlays(spark.readStream.schema(columns).parquet(path))
        query = stream.writeStream.foreachBatch(lambda d, _: out.extend(d.collect())).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    set_rows = {(r["kind"], r["key"], r["value"]) for r in out if r["alive"]}
    ended = {(r["kind"], r["key"]) for r in out if not r["alive"]}
    assert {("renamed", 1, "A"), ("count", 2, "3"), ("removed", 3, None)} <= set_rows
    assert {("renamed", 1), ("count", 2)} <= ended and ("removed", 4) not in ended


# -- store file ----------------------------------------------------------------------


@pytest.fixture
def store_path(tmp_path):
    path = str(tmp_path / "store.db")
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE ZICCLOUDSYNCINGOBJECT (Z_PK INTEGER PRIMARY KEY, Z_ENT INTEGER, ZTITLE1 TEXT, ZTITLE2 TEXT, ZNAME TEXT,
          ZFOLDER INTEGER, ZPARENT INTEGER, ZNOTE INTEGER, ZNOTEDATA INTEGER, ZIDENTIFIER TEXT, ZMARKEDFORDELETION INTEGER,
          ZMODIFICATIONDATE1 REAL, ZACCOUNT8 INTEGER, ZACCOUNT4 INTEGER, ZISPASSWORDPROTECTED INTEGER, ZMERGEABLEDATA1 BLOB);
        CREATE TABLE ZICNOTEDATA (Z_PK INTEGER PRIMARY KEY, ZDATA BLOB);
        CREATE TABLE Z_METADATA (Z_VERSION INTEGER, Z_UUID TEXT);
        CREATE TABLE ACHANGE (Z_PK INTEGER PRIMARY KEY, ZENTITY INTEGER, ZENTITYPK INTEGER, ZCHANGETYPE INTEGER);
        INSERT INTO Z_METADATA VALUES (1, 'UUID-1');
        INSERT INTO ACHANGE VALUES (1, 15, 300002, 2);
        INSERT INTO ZICCLOUDSYNCINGOBJECT (Z_PK, Z_ENT, ZNAME) VALUES (1, 14, 'Home');
        INSERT INTO ZICCLOUDSYNCINGOBJECT (Z_PK, Z_ENT, ZTITLE2, ZACCOUNT4) VALUES (2, 15, 'Top', 1), (300002, 15, 'Dropped', 1);
        INSERT INTO ZICCLOUDSYNCINGOBJECT (Z_PK, Z_ENT, ZTITLE2, ZPARENT, ZACCOUNT4) VALUES (3, 15, 'Sub', 2, 1);
        INSERT INTO ZICCLOUDSYNCINGOBJECT (Z_PK, Z_ENT, ZTITLE1, ZFOLDER, ZNOTEDATA, ZMODIFICATIONDATE1, ZIDENTIFIER, ZISPASSWORDPROTECTED)
          VALUES (4, 12, 'List', 3, 1, 700000000.5, 'n4', 0), (600005, 12, 'Shut', 2, 1, NULL, 'n5', 1);
        INSERT INTO ZICCLOUDSYNCINGOBJECT (Z_PK, Z_ENT, ZNOTE) VALUES (7, 5, 4);
    """)
    body = note_blob("List\nmilk\neggs", [(5, 0, None), (5, 103, True), (4, 103, False)])
    con.execute("INSERT INTO ZICNOTEDATA VALUES (1, ?)", (gzip.compress(body),))
    con.commit()
    con.close()
    return path


def test_store_file(spark, store_path, tmp_path):
    store = notestore.open_store(spark, store_path)
    assert store.uuid == "UUID-1" and not sqlite_store.has_fulltext(store_path)
    notes = {r["pk"]: r for r in store.notes.collect()}
    assert notes[4]["body"] == "List\nmilk\neggs" and notes[600005]["locked"] and notes[600005]["body"] is None
    listed = {r["name"]: r for r in cat.list_folders(store.folders, store.notes, store.accounts, store.changes).collect()}
    assert set(listed) == {"Top", "Sub"} and listed["Sub"]["path"] == "Top/Sub" and listed["Sub"]["account"] == "Home"
    assert store.attachments.collect()[0]["note_pk"] == 4
    html = spark.createDataFrame([(4, "<h1></h1><ul><li>milk</li><li>eggs</li></ul>")], "pk bigint, html string")
    from marginalia.operators.rendering import render_bodies

    decoded = notestore.decoded_bodies(store.notes)
    assert render_bodies(html, "pk", "html", "markdown", decoded).first()["body"] == "- [x] milk\n- [ ] eggs"
    with pytest.raises(sqlite_store.StoreError):
        notestore.open_store(spark, str(tmp_path / "absent.db"))


# -- edits ---------------------------------------------------------------------------


def test_note_edits(spark, engine):
    made = engine.create_notes([("First", "# Head\n\n- a\n- b"), ("Second", "")], "work/plans")
    assert [m["action"] for m in made] == ["created", "created"] and made[0]["id"] == "p9"
    assert engine.get_note("p9")["body"] == "Head\n\na\n\nb" and engine.get_note("p9")["folder"] == "Work/Plans"
    outcomes = engine.rename_notes(["p1", "p3", "p4", "f1", "p1"], ["A", "B", "C", "D", " "])
    assert [o["action"] for o in outcomes] == ["renamed", "skipped", "skipped", "skipped", "skipped"]
    assert engine.get_note("p1")["title"] == "A" and "locked" in outcomes[1]["error"] and "trash" in outcomes[2]["error"]
    assert "attachment" in engine.update_note("p2", "new")["error"]
    assert engine.update_note("p2", "**New** title\nrest", allow_attachment_loss=True)["action"] == "updated"
    assert engine.get_note("p2")["title"] == "New title"
    engine.update_note("p1", "more", append=True, format="text")
    assert engine.get_note("p1")["body"].endswith("totals\nmore")
    assert engine.move_notes(["p1"], "Notes")[0]["action"] == "moved" and engine.get_note("p1")["folder"] == "Notes"
    with pytest.raises(ValueError, match="trash"):
        engine.move_notes(["p1"], "Bin")
    deleted = engine.delete_notes(["p1", "p6", "p7"])
    assert [d["action"] for d in deleted] == ["deleted", "skipped", "deleted"] and "owner" in deleted[1]["error"]
    assert "p1" in [n["id"] for n in engine.list_notes("Bin").results]
    assert engine.delete_notes(["p6"], confirm_shared_delete=True)[0]["action"] == "deleted"


def test_folder_edits(engine):
    assert engine.create_folder("Deep", "Work/Plans")["action"] == "created"
    for args, match in ((("a/b",), "slash"), (("work",), "taken"), (("x", "Bin"), "trash"), (("x", "none"), "unknown"), ((" ",), "blank")):
        with pytest.raises(ValueError, match=match):
            engine.create_folder(*args)
    engine.rename_folder("f2", "Job")
    assert "Job/Plans/Deep" in {f["path"] for f in engine.list_folders()}
    for fid, match in (("f4", "trash"), ("f1", "default"), ("f10", "shared"), ("f2", "holds 2"), ("f77", "unknown"), ("p1", "not-a-folder")):
        with pytest.raises(ValueError, match=match):
            engine.delete_folder(fid)
    with pytest.raises(ValueError, match="subfolders"):
        engine.delete_folder("f2", allow_non_empty=True)
    engine.delete_folder("f2", recursive=True, note_disposition="preserve")
    assert not {"Job", "Plans", "Deep"} & {f["name"] for f in engine.list_folders()}
    assert {"p1", "p2", "p3"} <= {n["id"] for n in engine.list_notes("Notes").results}


def test_orphaned_subfolders_become_roots(engine):
    engine.delete_folder("f2", allow_non_empty=True, allow_orphaned_subfolders=True)
    assert "Plans" in {f["path"] for f in engine.list_folders()}
    assert {"p1", "p3", "p4"} == {n["id"] for n in engine.list_notes("Bin").results}


# -- answers that must be whole --------------------------------------------------------


def test_deep_and_cyclic_folders(spark):
    rows = [folder(i, f"F{i}", parent=i - 1 if i > 1 else None) for i in range(1, 41)]
    rows += [folder(50, "A", parent=51), folder(51, "B", parent=50), folder(52, "C", parent=51)]
    folders = spark.createDataFrame(rows, schema.FOLDERS)
    paths = {r["pk"]: (r["path"], r["depth"]) for r in cat.folder_paths(folders).collect()}
    assert len(paths) == 40 and paths[40] == ("/".join(f"F{i}" for i in range(1, 41)), 39)
    assert {(r["pk"], r["depth"]) for r in mutations.subtree(folders, 3).collect()} == {(i, i - 3) for i in range(3, 41)}
    assert {(r["pk"], r["depth"]) for r in mutations.subtree(folders, 50).collect()} == {(50, 0), (51, 1), (52, 2)}


def test_nearest_notes_beside_a_note_of_many_chunks(spark):
    rows = [(f"big#{i}", "big", "x", [1.0, i / 1000]) for i in range(50)] + [(f"n{i}#0", f"n{i}", "x", [1.0, 1.0 + i]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "id string, node_id string, content string, embedding array<float>")
    found = rt.semantic(chunks, [1.0, 0.0], 10).orderBy("rank").collect()
    assert [r["node_id"] for r in found] == ["big", *[f"n{i}" for i in range(9)]]
    second = rt.semantic(chunks, [1.0, 0.0], 10, offset=10).orderBy("rank").collect()
    assert [r["node_id"] for r in second] == [f"n{i}" for i in range(9, 19)]


def test_search_pages(engine):
    engine.reindex_semantic()
    for ask in (lambda **k: engine.semantic_search("spring", limit=1, **k), lambda **k: engine.fulltext_search("spring", limit=1, **k),
                lambda **k: engine.hybrid_search("spring", limit=1, depth=50, **k)):
        seen, cursor = [], None
        while True:
            page = ask(cursor=cursor)
            seen += [r.get("id", r.get("node_id")) for r in page.results]
            cursor = page.next_cursor
            if cursor is None:
                break
        assert len(seen) == len(set(seen)) >= 2
    with pytest.raises(ValueError, match="limit"):
        engine.semantic_search("spring", limit=0)


def test_null_flags_and_missing_default(spark, engine):
    engine.notes = engine.notes.withColumn("marked", F.when(F.col("pk") != 1, F.col("marked")))
    assert engine.get_note("p1")["id"] == "p1"
    engine.folders = engine.folders.where(~F.col("id").startswith("DefaultFolder-"))
    with pytest.raises(ValueError, match="default folder"):
        engine.create_notes([("x", "y")])


def test_no_provider_by_default(engine):
    bare = NotesEngine(engine.spark, engine.notes, engine.folders, config=engine.config)
    with pytest.raises(ValueError, match="provider"):
        bare.semantic_search("x")


def test_provider_batches_and_width(spark):
    @dataclass(frozen=True)
    class Sized(HashedEmbedder):
        def open(self):
            inner = super().open()
            return lambda texts: [v[: self.dim // 2] for v in inner(texts)] if any("narrow" in t for t in texts) else (
                inner(texts) if len(texts) <= 32 else [RuntimeError("too many at once")] * len(texts))

    texts = spark.createDataFrame([("t" * i,) for i in range(1, 101)] + [(None,)], "t string").coalesce(1)
    rows = texts.select("t", embed(F.col("t"), Sized(8)).alias("r")).collect()
    assert all((r["r"]["vector"] is None) == (r["t"] is None) and r["r"]["reason"] is None for r in rows)
    with pytest.raises(Exception, match="dimensions"):
        spark.createDataFrame([("narrow",)], "t string").select(embed(F.col("t"), Sized(8))).collect()


def test_manifest_is_never_taken_for_empty(spark, tmp_path):
    root = str(tmp_path / "s")
    first, other = Snapshots(spark, root), Snapshots(spark, root)
    assert first.current() is None
    one, two = first.begin(), other.begin()
    for store, version in ((first, one), (other, two)):
        store.write(spark.range(version), version, "t")
    first.publish(one)
    with pytest.raises(PassOvertaken):
        other.publish(two)
    assert Snapshots(spark, root).read("t").count() == 1
    with open(f"{root}/manifest/part-broken.json", "w") as torn:
        torn.write('{"version": 7, "crea')
    with pytest.raises(Exception):
        Snapshots(spark, root).current()


def test_owner_column_is_sought_among_folders(spark):
    rows = [(1, 15, None, "Top", 1, None), (2, 12, "Note", None, None, 5)]
    columns = "Z_PK bigint, Z_ENT int, ZTITLE1 string, ZTITLE2 string, ZACCOUNT4 bigint, ZACCOUNT8 bigint"
    wide = spark.createDataFrame(rows, columns).withColumns({
        c: F.lit(None).cast(k) for c, k in (("ZIDENTIFIER", "string"), ("ZFOLDER", "bigint"), ("ZPARENT", "bigint"), ("ZNOTEDATA", "bigint"),
                                            ("ZMODIFICATIONDATE1", "double"), ("ZNAME", "string"))})
    assert notestore.normalise(wide).folders.first()["account_pk"] == 1
