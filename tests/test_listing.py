"""Listings by key: the same rows with and without a layout, under edits, and few files read."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.functions import ids
from marginalia.operators import catalog as cat
from marginalia.operators import listing
from marginalia.plans.api import NotesEngine

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
FOLDERS = [
    (pk, f"F-{pk}", name, parent, kind, None, False, True, False, False)
    for pk, name, parent, kind in ((1, "Notes", None, 0), (2, "Work", None, 0), (3, "Plans", 2, 0), (4, "Bin", None, 1))
]


def notes(n=400, seed=3):
    """Notes with equal and missing times, marked, locked and untitled ones, in four folders."""
    dice = random.Random(seed)
    return [
        (pk, f"N-{pk}", None if pk % 31 == 0 else f"Title {pk}", dice.choice((1, 2, 3, 4)),
         None if pk % 29 == 0 else START + timedelta(hours=dice.randrange(120)), pk % 23 == 0, False, pk % 17 == 0, False, None, f"budget {pk}")
        for pk in range(1, n + 1)
    ]


def expected(rows, homes=(1, 2, 3), low=None, high=None):
    """Plain Python: ids in order of listing."""
    bounded = low is not None or high is not None
    shown = [
        r for r in rows if r[2] is not None and not r[5] and r[3] in homes and not (bounded and r[4] is None)
        and (low is None or r[4] >= low) and (high is None or r[4] <= high)]
    far = datetime.min.replace(tzinfo=timezone.utc)
    return [f"p{r[0]}" for r in sorted(shown, key=lambda r: (-((r[4] or far) - far) // timedelta(microseconds=1), r[0]))]


def walk(engine, limit=120, **scope):
    seen, totals, cursor = [], set(), None
    while True:
        page = engine.list_notes(limit=limit, cursor=cursor, **scope)
        seen += [r["id"] for r in page.results]
        totals.add(page.total_estimate)
        cursor = page.next_cursor
        if not page.has_more:
            return seen, totals


@pytest.fixture
def engine(spark):
    return NotesEngine(
        spark, spark.createDataFrame(notes(), schema.NOTES), spark.createDataFrame(FOLDERS, schema.FOLDERS),
        clock=lambda: START + timedelta(days=30))


@pytest.mark.parametrize("laid", [False, True])
def test_pages_equal_plain_python(engine, tmp_path, laid):
    if laid:
        engine.lay_out(str(tmp_path / "layout"), rows_per_file=20)
    whole = expected(notes())
    assert walk(engine) == (whole, {len(whole)})
    low, high = START + timedelta(hours=40), START + timedelta(hours=80)
    for after, before in ((low, None), (None, high), (low, high)):
        want = expected(notes(), low=after, high=before)
        found = walk(engine, 130, modified_after=after and after.isoformat(), modified_before=before and before.isoformat())
        assert found == (want, {len(want)})
    assert walk(engine, 150, folder_path="Work")[0] == expected(notes(), homes=(2, 3))
    assert walk(engine, 200, include_trash=True)[0] == expected(notes(), homes=(1, 2, 3, 4))
    readable = {f"p{r[0]}" for r in notes() if not r[7]}
    assert [r["id"] for r in engine.recent(30)] == [i for i in whole if i in readable][:30]


def test_edits_show_in_a_layout(engine, tmp_path):
    engine.lay_out(str(tmp_path / "layout"), rows_per_file=20)
    first = expected(notes())
    engine.delete_notes(first[:3])
    engine.move_notes(first[10:12], "Work")
    engine.create_notes([("Fresh", "text")], "Notes")
    seen, totals = walk(engine)
    rows = engine.notes.select(*[f.split()[0] for f in schema.NOTES.split(", ")]).collect()
    rows = [tuple(r[:4]) + (r["modified"] and r["modified"].replace(tzinfo=timezone.utc),) + tuple(r[5:]) for r in rows]
    assert engine._laid_out() and sorted(seen) == sorted(expected(rows)) and totals == {len(seen)}
    assert not set(first[:3]) & set(seen) and "Fresh" in {r["title"] for r in engine.list_notes(limit=5).results}
    # The order is that of the same rows without a layout.
    plain = NotesEngine(engine.spark, engine.notes, engine.folders)
    assert walk(plain, 150)[0] == seen
    # A new layout takes the edits in.
    engine.lay_out(str(tmp_path / "again"), rows_per_file=20)
    assert walk(engine, 150) == (seen, totals)


def test_a_late_page_reads_no_more_than_the_first(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "id pk", "concat('N-', id) id", "'t' title", "id % 3 + 1 folder_pk", "timestamp_seconds(1700000000 + id * 60) modified", "false marked",
        "false pinned", "false locked", "false shared", "cast(null as string) zone_owner", "'b' body")
    layout = listing.Layout.written(rows, str(tmp_path / "layout"), rows_per_file=100)
    homes = spark.range(1, 3).withColumnRenamed("id", "pk")
    opened = []
    for place in (0, 9_000, 19_500):
        pk = 19_999 - place
        after = {"late": -(1_700_000_000 + pk * 60) * 1_000_000, "pk": pk} if place else None
        files = layout.page_files(homes, 21, after)
        opened.append(len(files))
        want = [k for k in range(pk if not place else pk - 1, -1, -1) if k % 3 + 1 in (1, 2)][:21]
        assert [r["pk"] for r in layout.page(homes, 20, after).collect()] == want
    assert max(opened) <= 2 and len(layout._ranges.collect()) >= 200
    assert layout.total(homes) == sum(k % 3 != 2 for k in range(20_000))


def test_search_pages_by_key(engine):
    whole = [r["id"] for r in engine.search_notes("budget", limit=400).results]
    seen, cursor = [], None
    while True:
        page = engine.search_notes("budget", limit=150, cursor=cursor)
        seen, cursor = seen + [r["id"] for r in page.results], page.next_cursor
        if cursor is None:
            break
    assert seen == whole and set(whole) <= set(expected(notes()))


def test_cursors_are_checked(engine):
    with pytest.raises(ValueError):
        engine.list_notes(cursor=ids.encode_state(late="x", pk=1))
    with pytest.raises(ValueError):
        engine.list_notes(cursor="not a cursor")
    # A plain number is an offset.
    assert [r["id"] for r in engine.list_notes(limit=5, cursor=ids.encode_cursor(7)).results] == expected(notes())[7:12]


def test_an_empty_table(spark, tmp_path):
    engine = NotesEngine(spark, spark.createDataFrame([], schema.NOTES), spark.createDataFrame(FOLDERS, schema.FOLDERS))
    engine.lay_out(str(tmp_path / "layout"))
    page = engine.list_notes()
    assert (page.results, page.total_estimate, page.has_more) == ([], 0, False)
