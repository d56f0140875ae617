"""Compare a registered query with its SQL, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return repr(value)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in records)


def compare(frame, con, sql):
    """Return ``(spark_rows, sql_rows)`` in comparable form, after checking the column names."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(frame.columns) == sorted(names), (sorted(frame.columns), sorted(names))
    return rows_of(frame.columns, [tuple(r) for r in frame.collect()]), rows_of(names, cur.fetchall())
