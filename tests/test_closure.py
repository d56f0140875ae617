"""The kept folder tree gives what a new walk over the edited folders gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.operators import catalog as cat
from marginalia.operators import closure
from marginalia.plans.api import NotesEngine


def frame(spark, rows):
    return spark.createDataFrame(rows, "pk bigint, parent_pk bigint, name string")


def seen(rows):
    return sorted((r["pk"], r["path"], r["depth"]) for r in rows.collect())


def test_edits_equal_a_new_walk(spark):
    rng = random.Random(5)
    rows = {i: [i, rng.choice([None, *range(max(0, i - 6), i)]), f"F{i}"] for i in range(60)}
    rows |= {100: [100, 102, "A"], 101: [101, 100, "B"], 102: [102, 101, "C"], 103: [103, 101, "under a cycle"], 104: [104, 104, "own parent"], 105: [105, 999, "lost"]}
    tree = closure.folder_tree(frame(spark, [tuple(r) for r in rows.values()]))
    assert not {100, 101, 102, 103, 104} & {r["pk"] for r in tree.collect()} and (105, "lost", 0) in seen(closure.paths(tree))
    tree = closure.added(tree, 200, "New", 9)
    rows[200] = [200, 9, "New"]
    tree = closure.added(tree, 201, "Root", None)
    rows[201] = [201, None, "Root"]
    tree = closure.renamed(tree, 9, "Nine")
    rows[9][2] = "Nine"
    tree = closure.removed(tree, 20, recursive=False)
    del rows[20]
    rows = {k: [k, None if r[1] == 20 else r[1], r[2]] for k, r in rows.items()}
    below = {r["pk"] for r in closure.below(tree, 30).collect()}
    tree = closure.removed(tree, 30)
    rows = {k: r for k, r in rows.items() if k not in below}
    again = closure.folder_tree(frame(spark, [tuple(r) for r in rows.values()]))
    assert 30 in below and seen(closure.paths(tree)) == seen(closure.paths(again))
    assert seen(closure.paths(closure.folder_tree(frame(spark, [])))) == []


def test_a_deep_chain(spark):
    tree = closure.folder_tree(frame(spark, [(i, i - 1 if i else None, "x") for i in range(300)]))
    assert tree.agg(F.max(F.size("keys"))).first()[0] == 300
    assert {(r["pk"], r["depth"]) for r in closure.below(tree, 290).collect()} == {(i, i - 290) for i in range(290, 300)}


def test_engine_walks_once(spark, monkeypatch):
    walks = []
    walk = closure.folder_tree
    monkeypatch.setattr(closure, "folder_tree", lambda rows: walks.append(1) or walk(rows))
    folder = lambda pk, name, parent=None, kind=0, record=True, fetch=False: (
        pk, f"folder-{pk}", name, parent, kind, None, False, record, fetch, False)
    folders = spark.createDataFrame(
        [folder(1, "Work"), folder(2, "Plans", 1), folder(3, "Old", 2), folder(4, "Bin", None, 1), folder(5, "Hidden", 2, record=False, fetch=True),
         folder(6, "Under hidden", 5)], schema.FOLDERS)
    notes = spark.createDataFrame([(1, "n1", "Note", 3, None, False, False, False, False, None, "text")], schema.NOTES)
    engine = NotesEngine(spark, notes, folders)

    def paths():
        kept = {(f["id"], f["path"]) for f in engine.list_folders(include_trash=True)}
        visible = cat.visible_folders(engine.folders)
        fresh = visible.join(closure.paths(walk(visible)), "pk", "left")
        assert kept == {(f"f{r['pk']}", r["path"]) for r in fresh.collect()}
        return {path for _, path in kept}

    assert "Under hidden" in paths()
    made = engine.create_folder("Ideas", "Work/Plans")["id"]
    assert "Work/Plans/Ideas" in paths()
    engine.rename_folder("f1", "Job")
    assert "Job/Plans/Old" in paths() and [n["id"] for n in engine.list_notes("job").results] == ["p1"]
    engine.delete_folder(made)
    engine.delete_folder("f2", recursive=True, allow_non_empty=True)
    assert paths() == {"Job", "Bin"} and len(walks) <= 2
    with pytest.raises(ValueError):
        engine.list_notes("Job/Plans")
