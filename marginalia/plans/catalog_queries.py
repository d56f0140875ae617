"""Registered queries: folders, notes, identifiers."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from marginalia.functions import ids
from marginalia.operators import catalog as cat
from marginalia.operators import listing
from marginalia.plans import corpus
from marginalia.plans.registry import NOTES, SHOWN_TIME, WORLD, query
from marginalia.session import checkpoint_root

_PATHS = """
walk AS (
  SELECT f.pk, f.name AS path, 0 AS depth FROM {f} f
  WHERE f.parent_pk IS NULL OR f.parent_pk NOT IN (SELECT pk FROM {f})
  UNION ALL
  SELECT f.pk, w.path || '/' || f.name, w.depth + 1 FROM {f} f JOIN walk w ON f.parent_pk = w.pk
)"""
_VISIBLE = """
visible AS (
  SELECT * FROM folders WHERE (has_record OR pk NOT IN (SELECT pk FROM deletes)) AND (has_record OR NOT needs_fetch)
)"""


@query(f"WITH RECURSIVE {WORLD}, {_PATHS.format(f='folders')} SELECT pk, path, depth FROM walk")
def folder_paths(spark, sf_dir):
    return cat.folder_paths(corpus.world_folders(spark, sf_dir))


@query(f"""
WITH RECURSIVE {WORLD}, {_VISIBLE}, {_PATHS.format(f='visible')},
counts AS (SELECT l_suppkey + 1000000 AS pk, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT v.pk, 'f' || v.pk AS id, v.name, v.parent_pk, w.path, FALSE AS is_trash, 'Home' AS account,
       v.shared, coalesce(c.n, 0) AS note_count
FROM visible v LEFT JOIN walk w ON v.pk = w.pk LEFT JOIN counts c ON v.pk = c.pk
""")
def folder_listing(spark, sf_dir):
    accounts = spark.sql("select 1L as pk, 'Home' as name")
    return cat.list_folders(
        corpus.world_folders(spark, sf_dir),
        notes=corpus.world_notes(spark, sf_dir),
        accounts=accounts,
        changes=corpus.change_log(spark, sf_dir),
    )


@query("""
WITH f AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT lang || '/' || source AS path, source AS name, source = 'src19' AS is_trash, n AS note_count FROM f
UNION ALL
SELECT DISTINCT lang, lang, FALSE, CAST(0 AS BIGINT) FROM f
""")
def folder_counts(spark, sf_dir):
    rows = cat.list_folders(
        corpus.folders(spark, sf_dir), notes=corpus.notes(spark, sf_dir), include_trash=True
    )
    return rows.select("path", "name", "is_trash", "note_count")


@query(f"""
WITH {WORLD}
SELECT pk, name FROM folders WHERE has_record OR pk NOT IN (SELECT pk FROM deletes)
""")
def live_folders(spark, sf_dir):
    live = cat.live_folders(corpus.world_folders(spark, sf_dir), corpus.change_log(spark, sf_dir))
    return live.select("pk", "name")


@query(f"WITH {WORLD} SELECT pk, name FROM folders WHERE NOT has_record AND needs_fetch")
def ghost_folders(spark, sf_dir):
    return cat.ghost_folders(corpus.world_folders(spark, sf_dir)).select("pk", "name")


@query(f"WITH {WORLD} SELECT pk, name FROM folders WHERE pk IN (SELECT pk FROM deletes)")
def delete_logged(spark, sf_dir):
    rows = cat.delete_logged(corpus.world_folders(spark, sf_dir), corpus.change_log(spark, sf_dir), 15)
    return rows.select("pk", "name")


@query(f"""
WITH {WORLD}, live AS (SELECT pk FROM folders WHERE has_record OR pk NOT IN (SELECT pk FROM deletes))
SELECT l_suppkey + 1000000 AS folder_pk, l_linestatus = 'F' AS locked,
       CASE WHEN l_discount <= 0.05 THEN 'unshared' WHEN l_tax > 0.04 THEN 'participant' ELSE 'owner' END AS share_role,
       count(*) AS notes
FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey + 1000000 IN (SELECT pk FROM live)
GROUP BY 1, 2, 3
""")
def live_notes(spark, sf_dir):
    live = cat.live_notes(
        corpus.world_notes(spark, sf_dir),
        corpus.world_folders(spark, sf_dir),
        corpus.change_log(spark, sf_dir),
    )
    role = cat.share_role(F.col("shared"), F.col("zone_owner")).alias("share_role")
    return live.groupBy("folder_pk", "locked", role).agg(F.count("*").alias("notes"))


_ROW = f"'p' || pk AS id, title, folder_path AS folder, {SHOWN_TIME} AS modified, pinned, locked"


def _listed(rows):
    return rows.select(
        ids.short_id(F.col("pk")).alias("id"), "title", "folder",
        ids.display_time(F.col("modified")).alias("modified"), "pinned", "locked",
    )


def _paths(spark, sf_dir):
    return cat.folder_paths(cat.visible_folders(corpus.folders(spark, sf_dir)))


@query(f"WITH {NOTES} SELECT {_ROW} FROM notes WHERE NOT in_trash ORDER BY notes.modified DESC, pk LIMIT 21 OFFSET 40")
def list_notes_page(spark, sf_dir):
    rows = cat.select_notes(corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir))
    return _listed(cat.with_path(cat.page(rows, cat.recency(), 20, 40), _paths(spark, sf_dir)))


@query(f"""
WITH {NOTES} SELECT {_ROW} FROM notes
WHERE NOT in_trash AND notes.modified BETWEEN 1704067200 + 86400 AND 1704067200 + 20 * 86400
""")
def list_notes_range(spark, sf_dir):
    rows = cat.select_notes(
        corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir),
        after=datetime(2024, 1, 2, tzinfo=timezone.utc), before=datetime(2024, 1, 21, tzinfo=timezone.utc),
    )
    return _listed(cat.with_path(rows, _paths(spark, sf_dir)))


@query(f"WITH {NOTES} SELECT {_ROW} FROM notes WHERE lower(folder_path) = 'fr' OR starts_with(lower(folder_path), 'fr/')")
def scope_prefix(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    scope = paths.where(cat.in_scope(F.col("path"), "/FR/"))
    rows = cat.select_notes(corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir), scope=scope)
    return _listed(cat.with_path(rows, paths))


@query(f"WITH {NOTES} SELECT in_trash, count(*) AS notes FROM notes WHERE in_trash GROUP BY 1")
def trash_scope(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    scope = paths.where(F.lower("path").isin("de/src19", "en/src19", "es/src19", "fr/src19"))
    rows = cat.select_notes(corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir), scope=scope)
    return rows.groupBy(F.lit(True).alias("in_trash")).agg(F.count("*").alias("notes"))


_BOUNDS = "CAST(floor(max(modified - 1704067200) / 7200) AS BIGINT) * 3600 + 1704067200"


def _laid_out(spark, sf_dir):
    """The corpus in order of listing, in files of 500 rows, and the folders whose notes are listed."""
    path = f"{checkpoint_root(spark)}/layout-{uuid.uuid4().hex}"
    layout = listing.Layout.written(corpus.notes(spark, sf_dir), path, rows_per_file=500)
    return layout, cat.homes(corpus.folders(spark, sf_dir))


def _middle(layout):
    """The whole hour that halves the time from the origin to the last note, as ``late``."""
    last = -layout.notes.agg(F.min(listing.late())).first()[0] // 1_000_000
    return -(((last - corpus.ORIGIN) // 7200) * 3600 + corpus.ORIGIN) * 1_000_000


@query(f"""
WITH {NOTES}, bound AS (SELECT {_BOUNDS} AS middle FROM notes)
SELECT {_ROW} FROM notes, bound WHERE NOT in_trash AND notes.modified < middle ORDER BY notes.modified DESC, pk LIMIT 51
""")
def listing_page(spark, sf_dir):
    """The page that follows the middle of the corpus, read from the files that hold it."""
    layout, homes = _laid_out(spark, sf_dir)
    page = layout.page(homes, 50, after={"late": _middle(layout), "pk": listing.NO_TIME})
    return _listed(cat.with_path(page, _paths(spark, sf_dir)))


@query(f"""
WITH {NOTES}, bound AS (SELECT {_BOUNDS} AS middle FROM notes)
SELECT count(*) FILTER (NOT in_trash) AS listed, count(*) FILTER (NOT in_trash AND modified >= middle) AS later,
       count(*) FILTER (NOT in_trash AND modified <= middle) AS earlier FROM notes, bound
""")
def listing_totals(spark, sf_dir):
    """Totals of the listing, whole and on either side of its middle, as sums of counts by file."""
    layout, homes = _laid_out(spark, sf_dir)
    middle = _middle(layout)
    totals = (layout.total(homes), layout.total(homes, high=middle), layout.total(homes, low=middle))
    return spark.createDataFrame([totals], "listed bigint, later bigint, earlier bigint")


@query("SELECT l_orderkey AS note_pk, count(*) AS attachments FROM lineitem GROUP BY 1")
def attachment_counts(spark, sf_dir):
    items = corpus.table(spark, sf_dir, "lineitem")
    return cat.attachment_counts(items.select(F.col("l_orderkey").alias("note_pk")))


@query(f"""
WITH {NOTES} SELECT n.pk, title, locked, pinned FROM notes n
WHERE pk IN (SELECT user_id FROM events)
""")
def note_states(spark, sf_dir):
    asked = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("pk"))
    return cat.note_states(corpus.notes(spark, sf_dir), asked).select("pk", "title", "locked", "pinned")


@query(f"""
WITH {NOTES} SELECT id, pk AS z_pk, title, split_part(folder_path, '/', 2) AS folder, modified AS modified_at,
       locked, pinned, CASE WHEN NOT locked THEN length(body) END AS body_length
FROM notes WHERE NOT in_trash
""")
def index_source(spark, sf_dir):
    rows = cat.index_source(corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir))
    return rows.withColumn("body_length", F.length("body").cast("bigint")).drop("body")


@query("""
SELECT doc_id, substr(sha256(source || chr(10) || chr(10) || text), 1, 32) AS content_hash,
       'doc-' || doc_id || '#0' AS chunk_id,
       greatest(1, CAST(floor(length(text) / 2.5 * 1.1) AS INTEGER)) AS tokens
FROM documents
""")
def content_hash(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        ids.content_hash(F.col("source"), F.col("text")).alias("content_hash"),
        ids.chunk_key(F.concat(F.lit("doc-"), F.col("doc_id")), F.lit(0)).alias("chunk_id"),
        ids.approx_tokens(F.col("text")).alias("tokens"),
    )


@query("""
SELECT o_orderkey, replace(replace(to_base64(encode(CAST(o_orderkey AS VARCHAR))), '+', '-'), '/', '_') AS cursor,
       o_orderkey AS decoded, 'p' || o_orderkey AS note_id, 'f' || o_custkey AS folder_id,
       'note' AS kind, o_orderkey AS resolved, 'x-coredata://S/ICFolder/p' || o_custkey AS uri,
       'folder' AS uri_kind, o_custkey AS uri_pk, CAST(NULL AS VARCHAR) AS bad_kind
FROM orders
""")
def identifiers(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        ids.cursor_of(F.col("o_orderkey")).alias("cursor"),
        ids.short_id(F.col("o_orderkey")).alias("note_id"),
        ids.short_folder_id(F.col("o_custkey")).alias("folder_id"),
        ids.full_uri("S", "ICFolder", F.col("o_custkey")).alias("uri"),
        "o_orderstatus",
    )
    return rows.select(
        "o_orderkey", "cursor", ids.offset_of(F.col("cursor")).alias("decoded"), "note_id", "folder_id",
        ids.id_kind(F.col("note_id")).alias("kind"), ids.id_pk(F.col("note_id")).alias("resolved"), "uri",
        ids.id_kind(F.col("uri")).alias("uri_kind"), ids.id_pk(F.col("uri")).alias("uri_pk"),
        ids.id_kind(F.col("o_orderstatus")).alias("bad_kind"),
    )


@query("""
SELECT event_id, CASE WHEN value < 1 THEN '2001-01-01 00:00'
         ELSE strftime(make_timestamp(CAST(floor((value * 1000000 + 978307200) * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M') END
         AS catalog_time,
       CASE WHEN value < 1 THEN 0 ELSE CAST(floor(value * 1000000 + 978307200) AS BIGINT) END AS index_time
FROM events
""")
def clock_shift(spark, sf_dir):
    seconds = F.when(F.col("value") >= 1, F.col("value") * 1000000)
    return corpus.table(spark, sf_dir, "events").select(
        "event_id",
        ids.display_time(ids.catalog_time(seconds)).alias("catalog_time"),
        ids.index_time(seconds).alias("index_time"),
    )


@query("""
SELECT user_id, CAST(min(least(512, coalesce(CASE WHEN event_type = 'error' THEN
         greatest(256, CAST(floor(value * 10 * 0.9) AS INTEGER)) END, 512))) AS INTEGER) AS discovered
FROM events GROUP BY 1
""")
def capacity_ratchet(spark, sf_dir):
    # A refusal of unknown size counts as the smallest.
    observed = F.when(F.col("event_type") == "error", F.coalesce(F.col("value") * 10, F.lit(0.0)))
    after = ids.ratcheted_tokens(F.lit(512), observed)
    rows = corpus.table(spark, sf_dir, "events").select("user_id", after.alias("after"))
    return rows.groupBy("user_id").agg(ids.effective_tokens(F.lit(512), F.min("after")).alias("discovered"))
