"""Partitions of a SQLite table follow its rows, not the span of their ids."""

from __future__ import annotations

import sqlite3

from marginalia.sources import sqlite_store


def test_ids_far_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sqlite_store, "ROWS_PER_PARTITION", 10)
    path = str(tmp_path / "far.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT)")
    con.execute("CREATE TABLE none (id INTEGER PRIMARY KEY, name TEXT)")
    keys = [-(2**63), *range(25), 2**40, 2**62, 2**63 - 1]
    con.executemany("INSERT INTO t VALUES (?, ?)", [(k, f"row {k}") for k in keys])
    con.commit()
    con.close()
    schema = sqlite_store.SqliteTable({"path": path, "table": "t"}).schema()
    ranges = sqlite_store.SqliteReader(path, "t", schema).partitions()
    assert len(ranges) == 3 and ranges[0].low == keys[0] and ranges[-1].high == keys[-1]
    assert sorted(r["id"] for r in sqlite_store.read_table(spark, path, "t").collect()) == keys
    assert sqlite_store.read_table(spark, path, "none").collect() == []
