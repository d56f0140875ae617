"""Named queries over the provided tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# Common table expressions shared by the SQL side.
NOTES = """
notes AS (
  SELECT doc_id AS pk, 'doc-' || doc_id AS id, split_part(text, chr(10), 1) AS title,
         lang || '/' || source AS folder_path, 1704067200 + doc_id * 3600 AS modified,
         coalesce(quality, 0) = 1 AS pinned, coalesce(toxic, 0) = 1 AS locked, text AS body,
         source = 'src19' AS in_trash
  FROM documents LEFT JOIN labels USING (doc_id)
)"""
SHOWN_TIME = "strftime(make_timestamp(modified * 1000000), '%Y-%m-%d %H:%M')"

WORLD = """
folders AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS pk, r_name AS name, CAST(NULL AS BIGINT) AS parent_pk,
         TRUE AS has_record, FALSE AS needs_fetch, FALSE AS shared FROM region
  UNION ALL
  SELECT CAST(n_nationkey + 1000 AS BIGINT), n_name, CAST(n_regionkey + 1 AS BIGINT), TRUE, FALSE, FALSE FROM nation
  UNION ALL
  SELECT s_suppkey + 1000000, s_name, CAST(s_nationkey + 1000 AS BIGINT), s_acctbal >= 5000, s_acctbal < 0,
         s_acctbal >= 9000 FROM supplier
),
deletes AS (
  SELECT DISTINCT user_id + 1000000 AS pk FROM events WHERE event_type = 'error' AND value > 40
)"""
