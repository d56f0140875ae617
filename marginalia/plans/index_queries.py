"""Registered queries: index maintenance, overlays, edits."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from marginalia.functions import ids
from marginalia.operators import capacity
from marginalia.operators import catalog as cat
from marginalia.operators import closure
from marginalia.operators import indexing as ix
from marginalia.operators import mutations as mu
from marginalia.operators import overlays as ov
from marginalia.operators.embedding import HashedEmbedder
from marginalia.plans import corpus
from marginalia.plans.registry import NOTES, query
from marginalia.session import checkpoint_root

# Two states of one chunk table: since the first, users' turns changed, late turns came, early ones went.
_STATES = """
cur AS (SELECT conv_id AS node_id, turn, conv_id || '#' || turn AS id, role || ': ' || text AS body FROM conversations WHERE turn > 0),
prev AS (SELECT conv_id AS node_id, turn, conv_id || '#' || turn AS id,
  CASE WHEN role = 'user' THEN text ELSE role || ': ' || text END AS body FROM conversations WHERE turn < 5),
diff AS (SELECT c.*, CASE WHEN p.id IS NULL THEN 'new' WHEN p.body <> c.body THEN 'changed' ELSE 'kept' END AS state
  FROM cur c LEFT JOIN prev p USING (id))"""


def _state(spark, sf_dir, current: bool):
    turns = corpus.table(spark, sf_dir, "conversations")
    named = F.concat("role", F.lit(": "), "text")
    body = named if current else F.when(F.col("role") == "user", F.col("text")).otherwise(named)
    rows = turns.where("turn > 0" if current else "turn < 5").select(
        F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("node_id"),
        F.col("turn").cast("int").alias("chunk_index"),
        body.alias("content"),
        ids.content_hash(F.lit(None).cast("string"), body).alias("content_hash"),
    )
    return rows if current else rows.withColumn("embedding", F.array(F.length("content").cast("float")))


def _diffed(spark, sf_dir):
    return ix.diff_chunks(_state(spark, sf_dir, True), _state(spark, sf_dir, False))


@query(f"""WITH {_STATES} SELECT id, CAST(node_id AS VARCHAR) AS node_id, state,
  CASE WHEN state = 'kept' THEN CAST(length(body) AS DOUBLE) END AS reused FROM diff""")
def index_diff(spark, sf_dir):
    return _diffed(spark, sf_dir).select("id", "node_id", "state", F.get("embedding", F.lit(0)).cast("double").alias("reused"))


@query(f"WITH {_STATES} SELECT id FROM prev WHERE id NOT IN (SELECT id FROM cur)")
def stale_chunks(spark, sf_dir):
    return ix.stale_chunks(_state(spark, sf_dir, False), _state(spark, sf_dir, True)).select("id")


@query("SELECT 'doc-' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tombstone_sweep(spark, sf_dir):
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id")
    before, now = (corpus.table(spark, sf_dir, t).select(name) for t in ("documents", "labels"))
    return ix.tombstones(before, now)


_COUNTS = f"""WITH {_STATES}, tried AS (SELECT *, state <> 'kept' AND length(body) > 400 AS failed FROM diff),
per AS (SELECT node_id, count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (state <> 'kept' AND NOT failed) AS embedded,
  count(*) FILTER (failed) AS failed FROM tried GROUP BY 1),
gone AS (SELECT node_id, count(*) AS removed FROM prev WHERE id NOT IN (SELECT id FROM cur) GROUP BY 1)"""


def _attempts(spark, sf_dir):
    failed = (F.col("state") != "kept") & (F.length("content") > 400)
    rows = _diffed(spark, sf_dir).withColumn("reason", F.when(failed, "too-long"))
    return rows.withColumn("error", F.when(failed, F.concat(F.length("content").cast("string"), F.lit(" characters"))))


def _conversation_nodes(spark, sf_dir):
    return corpus.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns")).select(
        F.col("conv_id").cast("string").alias("id"), (F.col("turns") > 8).alias("locked")
    )


@query(f"""{_COUNTS}
SELECT (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) <= 8)) AS indexed,
  (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) > 8)) AS skipped,
  (SELECT count(*) FROM prev WHERE id NOT IN (SELECT id FROM cur)) AS deleted,
  (SELECT CAST(sum(embedded) AS BIGINT) FROM per) AS chunks_embedded,
  (SELECT CAST(sum(greatest(0, kept - coalesce(removed, 0))) AS BIGINT) FROM per LEFT JOIN gone USING (node_id)) AS chunks_skipped,
  (SELECT CAST(sum(failed) AS BIGINT) FROM per) AS chunks_failed
""")
def index_counters(spark, sf_dir):
    stale = ix.stale_chunks(_state(spark, sf_dir, False), _state(spark, sf_dir, True))
    return ix.pass_stats(_attempts(spark, sf_dir), stale, _conversation_nodes(spark, sf_dir), stale)


@query(f"""{_COUNTS}
SELECT id AS chunk_id, CAST(node_id AS VARCHAR) AS node_id, 'too-long' AS reason, length(body) || ' characters' AS error_message
FROM tried WHERE failed
UNION ALL
SELECT conv_id || '#0', CAST(conv_id AS VARCHAR), 'locked', 'note is password-protected; body inaccessible'
FROM conversations GROUP BY conv_id HAVING max(turn) > 8
""")
def index_failures(spark, sf_dir):
    return ix.failures(_attempts(spark, sf_dir), _conversation_nodes(spark, sf_dir), 0).drop("failed_at")


@query(f"""WITH {NOTES} SELECT id, title, locked,
  substr(sha256(title || chr(10) || chr(10) || CASE WHEN locked THEN '' ELSE body END), 1, 32) AS content_hash FROM notes WHERE NOT in_trash""")
def index_nodes(spark, sf_dir):
    source = cat.index_source(corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir))
    return ix.to_nodes(source).select("id", "title", "locked", "content_hash")


# The two states as notes, a conversation each, which two passes of one index see.
_NOTE_STATES = f"""{_STATES},
now AS (SELECT 'c' || node_id AS id, 'Talk ' || node_id AS title, string_agg(body, chr(10) ORDER BY turn) AS body FROM cur GROUP BY node_id),
old AS (SELECT 'c' || node_id AS id, string_agg(body, chr(10) ORDER BY turn) AS body FROM prev GROUP BY node_id)"""


def _talks(spark, sf_dir, current: bool):
    turns = _state(spark, sf_dir, current).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("turns"))
    return turns.select(
        F.concat(F.lit("c"), "node_id").alias("id"), F.col("node_id").cast("bigint").alias("z_pk"),
        F.concat(F.lit("Talk "), "node_id").alias("title"), F.lit("Talks").alias("folder"), F.lit(0).cast("bigint").alias("modified_at"),
        F.lit(False).alias("locked"), F.lit(False).alias("pinned"), F.array_join("turns.content", "\n").alias("body"))


def _indexed(spark, sf_dir):
    """An index of the first state after a pass over the second."""
    index = ix.Index(spark, f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}")
    for current in (False, True):
        index.reindex(_talks(spark, sf_dir, current), HashedEmbedder(8))
    return index


@query(f"""WITH {_NOTE_STATES}
SELECT id, substr(sha256(title || chr(10) || chr(10) || body), 1, 32) AS content_hash,
  CAST(len(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) + len(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')) AS BIGINT) AS words
FROM now""")
def index_merge_read(spark, sf_dir):
    """What readers see of two segments: each note once, as it is now, and the words its postings hold."""
    index = _indexed(spark, sf_dir)
    words = index.postings().groupBy("node_id").agg(F.sum(F.size("title_at") + F.size("body_at")).cast("bigint").alias("words"))
    return index.nodes().select("id", "content_hash").join(words.withColumnRenamed("node_id", "id"), "id", "left").fillna(0, ["words"])


@query(f"""WITH {_NOTE_STATES}
SELECT id, title, substr(sha256(title || chr(10) || chr(10) || body), 1, 32) AS content_hash FROM now ORDER BY md5(id), id LIMIT 20""")
def index_few_rows(spark, sf_dir):
    """The rows of a page of 20 notes, read from the files of two segments that hold them."""
    index = _indexed(spark, sf_dir).pinned()
    page = index.nodes().select("id").orderBy(F.md5("id"), "id").limit(20)
    return index.few_nodes([r["id"] for r in page.collect()]).select("id", "title", "content_hash")


@query(f"""WITH {_NOTE_STATES}
SELECT coalesce(n.id, o.id) AS id, n.id IS NOT NULL AS written, o.id IS NOT NULL AS replaced
FROM now n FULL JOIN old o ON n.id = o.id WHERE n.body IS DISTINCT FROM o.body""")
def index_pass_changed(spark, sf_dir):
    """What the second pass wrote: rows of changed notes, and keys whose rows no longer count."""
    index = _indexed(spark, sf_dir)
    rows = index.store.read("nodes").select("id", F.lit(True).alias("written"))
    keys = index.store.read("replaced").where("part = 'text'").select("id", F.lit(True).alias("replaced"))
    return rows.join(keys, "id", "full").select("id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("written", "replaced")])


# -- overlays ------------------------------------------------------------------

_NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
# The clock stands at the last event.
_EVENTS = """
ev AS (SELECT *, ts + INTERVAL 6 HOUR AS deadline, max(ts) OVER () AS now FROM events)"""


def _clock(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def _overlays(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", ov.REMOVED).when(F.col("event_type") == "view", ov.COUNT)
    rows = events.select(
        kind.otherwise(ov.RENAMED).alias("kind"), F.col("user_id").alias("key"),
        F.floor("value").cast("string").alias("value"), "ts", "event_id",
    )
    return ov.with_deadline(rows, F.col("ts"), 6 * 3600).select("kind", "key", "value", "deadline")


@query(f"""WITH {_EVENTS}
SELECT CASE event_type WHEN 'error' THEN 'removed' WHEN 'view' THEN 'count' ELSE 'renamed' END AS kind, user_id AS key,
  CAST(CAST(floor(arg_max(value, deadline)) AS BIGINT) AS VARCHAR) AS value
FROM ev WHERE deadline > now GROUP BY 1, 2""")
def overlay_active(spark, sf_dir):
    return ov.active(_overlays(spark, sf_dir), _clock(spark, sf_dir)).drop("deadline")


@query(f"""WITH {_EVENTS} SELECT user_id AS key, CAST(sum(floor(value)) AS BIGINT) AS delta FROM ev WHERE event_type = 'view'
GROUP BY 1 HAVING max(deadline) > max(now)""")
def overlay_counts(spark, sf_dir):
    return ov.count_deltas(_overlays(spark, sf_dir), _clock(spark, sf_dir))


@query("""
WITH f AS (SELECT DISTINCT lang, source FROM documents),
paths AS (SELECT lang AS path FROM f UNION SELECT lang || '/' || source FROM f)
SELECT path AS old_path, CASE WHEN path = 'en' THEN 'english' WHEN path = 'fr/src3' THEN 'fr/three'
  WHEN starts_with(path, 'en/') THEN 'english/' || substr(path, 4) ELSE path END AS path
FROM paths WHERE path <> 'de/src7'
""")
def overlay_renames(spark, sf_dir):
    folders = corpus.folders(spark, sf_dir)
    listing = cat.list_folders(folders, include_trash=True).withColumn("old_path", F.col("path"))
    given = spark.createDataFrame(
        [(ov.RENAMED, "en", "english"), (ov.RENAMED, "fr/src3", "fr/three"), (ov.REMOVED, "de/src7", None)],
        "kind string, path string, value string",
    )
    alive = given.select("kind", corpus.path_key(F.col("path")).alias("key"), "value")
    return ov.apply_renames(ov.without_removed(listing, alive), alive).select("old_path", "path")


# -- edits ---------------------------------------------------------------------

# Requests drawn from the events: notes by number, some malformed and some unknown.
_REQUESTS = f"""{NOTES}, req AS (
  SELECT event_id AS request_no, CASE WHEN event_type = 'view' THEN 'f' ELSE 'p' END || (user_id * 3) AS note_id,
    user_id * 3 AS pk, event_type = 'view' AS bad, event_type || ' ' || event_id AS new_title FROM events
), judged AS (
  SELECT r.*, CASE WHEN bad THEN 'not-a-note: ' || note_id WHEN n.pk IS NULL THEN 'unknown-note: ' || note_id
    WHEN n.locked THEN 'locked: ' || note_id WHEN n.in_trash THEN 'in-trash: ' || note_id END AS error
  FROM req r LEFT JOIN notes n ON n.pk = r.pk
)"""


def _requests(spark, sf_dir):
    events = corpus.table(spark, sf_dir, "events")
    letter = F.when(F.col("event_type") == "view", "f").otherwise("p")
    return events.select(
        F.col("event_id").alias("request_no"),
        F.concat(letter, (F.col("user_id") * 3).cast("string")).alias("note_id"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("new_title"),
    )


def _edit(spark, sf_dir, change, *rest):
    return change(corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir), _requests(spark, sf_dir), *rest, F.lit(_NOON))


@query(f"""WITH {_REQUESTS} SELECT request_no, note_id AS id,
  CASE WHEN error IS NULL THEN 'renamed' ELSE 'skipped' END AS action, error FROM judged""")
def rename_outcomes(spark, sf_dir):
    return _edit(spark, sf_dir, mu.rename_notes).outcomes


@query(f"""WITH {_REQUESTS}, won AS (
  SELECT pk, arg_max(new_title, request_no) AS new_title FROM judged WHERE error IS NULL GROUP BY 1)
SELECT n.pk, coalesce(w.new_title, n.title) AS title, w.pk IS NOT NULL AS touched FROM notes n LEFT JOIN won w ON n.pk = w.pk""")
def rename_merge(spark, sf_dir):
    table = _edit(spark, sf_dir, mu.rename_notes).table
    return table.select("pk", "title", (F.col("modified") == F.lit(_NOON)).alias("touched"))


@query(f"""WITH {_REQUESTS}, won AS (SELECT DISTINCT pk FROM judged WHERE error IS NULL)
SELECT n.pk, w.pk IS NOT NULL AS moved FROM notes n LEFT JOIN won w ON n.pk = w.pk""")
def move_merge(spark, sf_dir):
    table = _edit(spark, sf_dir, mu.move_notes, 12345).table
    return table.select("pk", (F.col("folder_pk") == 12345).alias("moved"))


@query(f"""WITH {_REQUESTS}, won AS (SELECT DISTINCT pk FROM judged WHERE error IS NULL)
SELECT n.pk, w.pk IS NOT NULL AS deleted FROM notes n LEFT JOIN won w ON n.pk = w.pk""")
def delete_merge(spark, sf_dir):
    folders = corpus.folders(spark, sf_dir)
    table = _edit(spark, sf_dir, mu.delete_notes).table
    before = corpus.notes(spark, sf_dir).select("pk", F.col("folder_pk").alias("old"))
    trash = cat.trash_folders(folders).select(F.col("pk").alias("folder_pk"), F.lit(True).alias("in_trash"))
    rows = table.join(before, "pk").join(trash, "folder_pk", "left")
    return rows.select("pk", (F.coalesce("in_trash", F.lit(False)) & (F.col("folder_pk") != F.col("old"))).alias("deleted"))


def _bodies(spark, sf_dir):
    return _requests(spark, sf_dir).withColumnRenamed("new_title", "body")


@query(f"""WITH {_REQUESTS} SELECT request_no, note_id AS id,
  CASE WHEN error IS NULL THEN 'updated' ELSE 'skipped' END AS action, error FROM judged""")
def update_outcomes(spark, sf_dir):
    notes, folders = corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir)
    return mu.update_notes(notes, folders, _bodies(spark, sf_dir), F.lit(_NOON), fmt="text").outcomes


_WON = f"{_REQUESTS}, won AS (SELECT pk, arg_max(new_title, request_no) AS body FROM judged WHERE error IS NULL GROUP BY 1)"


@query(f"""WITH {_WON} SELECT n.pk, coalesce(w.body, n.title) AS title, md5(coalesce(w.body, n.body)) AS body
FROM notes n LEFT JOIN won w ON n.pk = w.pk""")
def update_merge(spark, sf_dir):
    notes, folders = corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir)
    table = mu.update_notes(notes, folders, _bodies(spark, sf_dir), F.lit(_NOON), fmt="text").table
    return table.select("pk", "title", F.md5(F.col("body").cast("binary")).alias("body"))


@query(f"""WITH {_WON} SELECT n.pk, n.title, md5(CASE WHEN w.pk IS NULL THEN n.body ELSE concat_ws(chr(10), nullif(n.body, ''), w.body) END) AS body
FROM notes n LEFT JOIN won w ON n.pk = w.pk""")
def append_merge(spark, sf_dir):
    notes, folders = corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir)
    table = mu.update_notes(notes, folders, _bodies(spark, sf_dir), F.lit(_NOON), append=True, fmt="text").table
    return table.select("pk", "title", F.md5(F.col("body").cast("binary")).alias("body"))


@query(f"""WITH {NOTES}, top AS (SELECT max(pk) AS top FROM notes)
SELECT pk, title, md5(body) AS body FROM notes
UNION ALL SELECT top + event_id + 1, event_type, md5('value ' || event_id) FROM events, top""")
def create_merge(spark, sf_dir):
    requests = corpus.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_no"), F.col("event_type").alias("title"),
        F.concat_ws(" ", F.lit("value"), F.col("event_id").cast("string")).alias("body"))
    table = mu.create_notes(corpus.notes(spark, sf_dir), requests, 12345, F.lit(_NOON), fmt="text").table
    return table.select("pk", "title", F.md5(F.col("body").cast("binary")).alias("body"))


@query("""WITH top AS (SELECT max(s_suppkey) + 1000001 AS pk FROM supplier)
SELECT s_suppkey + 1000000 AS pk, s_name AS name, s_nationkey + 1000 AS parent_pk FROM supplier
UNION ALL SELECT n_nationkey + 1000, n_name, n_regionkey + 1 FROM nation
UNION ALL SELECT r_regionkey + 1, r_name, NULL FROM region
UNION ALL SELECT pk, 'Fresh', (SELECT CAST(r_regionkey + 1 AS BIGINT) FROM region WHERE r_name = 'ASIA') FROM top""")
def folder_create(spark, sf_dir):
    folders = corpus.world_folders(spark, sf_dir)
    made, _ = mu.create_folder(folders, cat.list_folders(folders), "Fresh", "asia")
    return made.select("pk", "name", F.col("parent_pk").cast("bigint").alias("parent_pk"))


@query("""SELECT CAST(r_regionkey + 1 AS BIGINT) AS pk, CASE WHEN r_regionkey = 2 THEN 'East' ELSE r_name END AS name FROM region
UNION ALL SELECT n_nationkey + 1000, n_name FROM nation UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier""")
def folder_rename(spark, sf_dir):
    folders = corpus.world_folders(spark, sf_dir)
    return mu.rename_folder(folders, cat.list_folders(folders), "f3", "East").select("pk", "name")


@query("""
WITH gone AS (SELECT CAST(3 AS BIGINT) AS pk UNION ALL SELECT n_nationkey + 1000 FROM nation WHERE n_regionkey = 2
  UNION ALL SELECT s_suppkey + 1000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2)
SELECT l_orderkey * 10 + l_linenumber AS pk, CASE WHEN g.pk IS NULL THEN l_suppkey + 1000000 END AS folder_pk
FROM lineitem LEFT JOIN gone g ON g.pk = l_suppkey + 1000000
""")
def folder_delete(spark, sf_dir):
    """A region goes with all below it; without a trash folder its notes are left without a folder."""
    folders = corpus.world_folders(spark, sf_dir).withColumn("shared", F.lit(False))
    _, notes, _ = mu.delete_folder(folders, corpus.world_notes(spark, sf_dir), cat.list_folders(folders), "f3", recursive=True)
    return notes.select("pk", "folder_pk")


@query("""
WITH RECURSIVE tree AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS pk, CAST(NULL AS BIGINT) AS parent_pk FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey + 1 FROM nation
  UNION ALL SELECT s_suppkey + 1000000, s_nationkey + 1000 FROM supplier
), down AS (SELECT pk, 0 AS depth FROM tree WHERE pk = 3 UNION ALL SELECT t.pk, d.depth + 1 FROM tree t JOIN down d ON t.parent_pk = d.pk)
SELECT pk, depth FROM down
""")
def folder_subtree(spark, sf_dir):
    return mu.subtree(corpus.world_folders(spark, sf_dir), 3)


@query("""
WITH RECURSIVE base AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS pk, CAST(NULL AS BIGINT) AS parent_pk, CASE WHEN r_regionkey = 2 THEN 'East' ELSE r_name END AS name
  FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey + 1, n_name FROM nation WHERE n_regionkey <> 3
  UNION ALL SELECT s_suppkey + 1000000, CASE WHEN n_regionkey = 3 THEN NULL ELSE s_nationkey + 1000 END, s_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1
  UNION ALL SELECT CAST(7 AS BIGINT), CAST(3 AS BIGINT), 'Fresh'
), tree AS (
  SELECT pk, name AS path, 0 AS depth FROM base WHERE parent_pk IS NULL
  UNION ALL SELECT b.pk, t.path || '/' || b.name, t.depth + 1 FROM base b JOIN tree t ON b.parent_pk = t.pk
)
SELECT pk, path, depth FROM tree WHERE pk <> 2 AND pk NOT IN (SELECT n_nationkey + 1000 FROM nation WHERE n_regionkey = 1)
""")
def folder_tree_edits(spark, sf_dir):
    """A renamed region, a new folder in it, one region gone with all below, and the nations of another gone without their suppliers."""
    nations = corpus.table(spark, sf_dir, "nation").where("n_regionkey = 3").select("n_nationkey").collect()
    tree = closure.folder_tree(corpus.world_folders(spark, sf_dir))
    tree = closure.added(closure.renamed(tree, 3, "East"), 7, "Fresh", 3)
    tree = closure.removed(tree, 2)
    for nation in nations:
        tree = closure.removed(tree, nation["n_nationkey"] + 1000, recursive=False)
    return closure.paths(tree)


# Longest texts that the providers take in each of three passes; each language stands for a provider.
_LIMITS = (1500, 700, 2500)


@query("""
WITH texts AS (SELECT lang AS provider, length(text) AS n FROM documents WHERE lang IS NOT NULL
), learned AS (
  SELECT provider, n, greatest(256, CAST(floor(greatest(1, floor(n / CAST(2.5 AS DOUBLE) * CAST(1.1 AS DOUBLE))) * CAST(0.9 AS DOUBLE)) AS INTEGER)) AS t
  FROM texts
), passes AS (
  SELECT provider, min(t) FILTER (n > 1500) AS a, min(t) FILTER (n > 700) AS b, min(t) FILTER (n > 2500) AS c
  FROM learned GROUP BY provider
)
SELECT provider, 512 AS advertised, least(a, b, c) AS discovered,
  CAST(CASE WHEN c < coalesce(least(a, b), c + 1) THEN 3 WHEN b < coalesce(a, b + 1) THEN 2 WHEN a IS NOT NULL THEN 1 END AS BIGINT) AS discovered_at,
  coalesce(least(512, a, b, c), 512) AS max_tokens, CAST(floor(coalesce(least(512, a, b, c), 512) * 2.5) AS INTEGER) AS chunk_chars
FROM passes
""")
def capacity_table(spark, sf_dir):
    texts = corpus.table(spark, sf_dir, "documents").where("lang is not null").select(
        F.col("lang").alias("provider"), F.lit(None).cast("string").alias("heading"), F.col("text").alias("content"))
    asked = capacity.advertised_tokens(texts.select("provider", F.lit(512).alias("advertised")).distinct(), 0)
    table = asked
    for at, limit in enumerate(_LIMITS, 1):
        attempts = texts.withColumn("reason", F.when(F.length("content") > limit, "too-long"))
        table = capacity.upserted(table, asked, capacity.refused_tokens(attempts), at)
    return table.select(
        "provider", "advertised", "discovered", "discovered_at", capacity.effective().alias("max_tokens"), capacity.budget().alias("chunk_chars"))
