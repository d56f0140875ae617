"""Registered queries: scan search, counts and snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import ids
from marginalia.functions import text as tx
from marginalia.operators import catalog as cat
from marginalia.operators import lexical as lex
from marginalia.plans import corpus
from marginalia.plans.registry import NOTES, SHOWN_TIME, query


def _count(hay: str, needle: str) -> str:
    return (f"CAST((length(lower({hay})) - length(replace(lower({hay}), '{needle}', ''))) / {len(needle)} AS BIGINT)")


_HAY = "title || chr(10) || CASE WHEN locked THEN '' ELSE body END"
_HIT = f"NOT in_trash AND (contains(lower(title), '{{q}}') OR (NOT locked AND contains(lower(body), '{{q}}')))"


def _searchable(spark, sf_dir):
    return cat.select_notes(corpus.notes(spark, sf_dir), corpus.folders(spark, sf_dir))


def _hits(rows):
    return rows.select("pk", F.round("score", 6).alias("score"), "match_count", "locked")


@query(f"""
WITH {NOTES} SELECT pk, CAST(1.0 AS DOUBLE) AS score,
  CASE WHEN locked THEN {_count('title', 'theand')} ELSE {_count(_HAY, 'theand')} END AS match_count, locked
FROM notes WHERE {_HIT.format(q='theand')}
""")
def search_substring(spark, sf_dir):
    return _hits(lex.match_notes(_searchable(spark, sf_dir), "TheAnd"))


@query(f"""
WITH {NOTES}, hits AS (SELECT *, CASE WHEN NOT locked AND contains(lower(body), 'ement') THEN body ELSE title END AS seen
  FROM notes WHERE {_HIT.format(q='ement')})
SELECT pk, CAST(1.0 AS DOUBLE) AS score, CASE WHEN locked THEN {_count('title', 'ement')}
  ELSE {_count("title || chr(10) || seen", 'ement')} END AS match_count, locked
FROM hits
""")
def search_title_stands_in(spark, sf_dir):
    return _hits(lex.match_notes(_searchable(spark, sf_dir), "ement", title_stands_in=True))


@query(f"""
WITH {NOTES} SELECT pk, CAST(1.0 AS DOUBLE) AS score, {_count('title || chr(10)', 'the')} AS match_count, locked
FROM notes WHERE NOT in_trash AND contains(lower(title), 'the')
""")
def search_titles(spark, sf_dir):
    return _hits(lex.match_notes(_searchable(spark, sf_dir), "the", search_body=False))


@query(f"""
WITH {NOTES} SELECT pk, CAST(1.0 AS DOUBLE) AS score, {_count('title', 'ing')} AS match_count, locked
FROM notes WHERE NOT in_trash AND locked AND contains(lower(title), 'ing')
""")
def search_locked(spark, sf_dir):
    return _hits(lex.match_notes(_searchable(spark, sf_dir), "ing").where("locked"))


@query(f"""
WITH {NOTES}, hits AS (SELECT *, regexp_extract({_HAY}, '(?i)th[aeo][a-z]{{4,6}}tion', 0) AS first_hit FROM notes
  WHERE NOT in_trash AND regexp_matches({_HAY}, '(?i)th[aeo][a-z]{{4,6}}tion'))
SELECT pk, CAST(1.0 AS DOUBLE) AS score, lower(first_hit) AS highlight,
  CAST((length(hay) - length(replace(lower(hay), lower(first_hit), ''))) / length(first_hit) AS BIGINT) AS match_count
FROM (SELECT *, CASE WHEN locked THEN title ELSE {_HAY} END AS hay FROM hits)
""")
def search_regex(spark, sf_dir):
    rows = lex.match_notes(_searchable(spark, sf_dir), r"th[aeo][a-z]{4,6}tion", mode="regex")
    return rows.select("pk", "score", F.lower("highlight").alias("highlight"), "match_count")


_WORDS = ("the", "ation", "ea", "ea")


def _fuzzy_sql(extra: str = "") -> str:
    seen = "CASE WHEN locked THEN '' ELSE lower(body) END"
    found = " + ".join(
        f"CAST(contains(lower(title), '{w}') OR contains({seen}, '{w}') AS INTEGER)" for w in sorted(set(_WORDS))
    )
    titled = " + ".join(f"CAST(contains(lower(title), '{w}') AS INTEGER)" for w in _WORDS)
    count = f"CASE WHEN locked THEN {_count('title', 'ation')} ELSE {_count(_HAY, 'ation')} END"
    return f"""
WITH {NOTES} SELECT pk, round(({found}) / 4.0 + 0.5 * (({titled}) / 4.0), 6) AS score, {count} AS match_count, locked
FROM notes WHERE {_HIT.format(q='ation')} {extra}
"""


@query(_fuzzy_sql())
def search_fuzzy(spark, sf_dir):
    return _hits(lex.match_notes(_searchable(spark, sf_dir), "The ATION EA ea x", fuzzy=True))


@query(_fuzzy_sql(f"AND contains(lower({_HAY}), 'the') AND contains(lower({_HAY}), 'ea')"))
def search_fuzzy_all(spark, sf_dir):
    return _hits(lex.match_notes(_searchable(spark, sf_dir), "The ATION EA ea x", fuzzy=True, require_all=True))


def _window_sql(text: str, start: str, end: str) -> str:
    cut = f"substr({text}, {start} + 1, {end} - {start})"
    return (
        f"(CASE WHEN {start} > 0 THEN '…' ELSE '' END || trim(regexp_replace({cut}, '\\s+', ' ', 'g')) || "
        f"CASE WHEN {end} < length({text}) THEN '…' ELSE '' END)"
    )


def _snippet_sql(source: str, query_len: int, needle: str, window: int) -> str:
    """Three successive matches, each sought past the window of the one before."""
    steps, prev = [f"s0 AS (SELECT *, lower(seen) AS low FROM {source})"], "s0"
    for i in (1, 2, 3):
        after = "0" if i == 1 else f"e{i - 1} + {2 * window}"
        live = "TRUE" if i == 1 else f"h{i - 1} > 0"
        steps.append(
            f"t{i} AS (SELECT *, CASE WHEN {live} THEN instr(substr(low, {after} + 1), '{needle}') ELSE 0 END AS r{i} FROM {prev}), "
            f"u{i} AS (SELECT *, CASE WHEN r{i} > 0 THEN r{i} + {after} ELSE 0 END AS h{i} FROM t{i}), "
            f"s{i} AS (SELECT *, greatest(0, h{i} - 1 - {window}) AS b{i}, "
            f"least(length(seen), h{i} - 1 + {query_len} + {window}) AS e{i} FROM u{i})"
        )
        prev = f"s{i}"
    spans = ", ".join(f"CASE WHEN h{i} > 0 THEN {_window_sql('seen', f'b{i}', f'e{i}')} END" for i in (1, 2, 3))
    opening = (
        f"trim(regexp_replace(substr(seen, 1, {2 * window}), '\\s+', ' ', 'g')) || "
        f"CASE WHEN length(seen) > {2 * window} THEN '…' ELSE '' END"
    )
    return f"{', '.join(steps)}, snips AS (SELECT *, CASE WHEN h1 > 0 THEN concat_ws(' ¦ ', {spans}) ELSE {opening} END AS snips FROM s3)"


@query(f"""
WITH {NOTES}, hits AS (SELECT *, CASE WHEN locked THEN title ELSE body END AS seen,
    CASE WHEN locked THEN {_count('title', 'theand')} ELSE {_count(_HAY, 'theand')} END AS match_count
  FROM notes WHERE {_HIT.format(q='theand')} ORDER BY modified DESC, pk LIMIT 11 OFFSET 10),
{_snippet_sql('hits', 6, 'theand', 100)}
SELECT 'p' || pk AS id, title, folder_path AS folder, {SHOWN_TIME} AS modified, match_count, locked,
  CASE WHEN locked THEN '[locked — title matched; body encrypted]' ELSE snips END AS snippets
FROM snips
""")
def search_page(spark, sf_dir):
    return found_page(spark, sf_dir, 10)


def found_page(spark, sf_dir, offset):
    """A page of hits from ``offset`` on, with snippets."""
    hits = lex.match_notes(_searchable(spark, sf_dir), "TheAnd")
    rows = lex.with_snippets(cat.page(hits, lex.ranking(), 10, offset))
    paths = cat.folder_paths(cat.visible_folders(corpus.folders(spark, sf_dir)))
    return cat.with_path(rows, paths).select(
        ids.short_id(F.col("pk")).alias("id"), "title", "folder",
        ids.display_time(F.col("modified")).alias("modified"), "match_count", "locked",
        F.concat_ws(" ¦ ", "snippets").alias("snippets"),
    )


@query(f"WITH src AS (SELECT doc_id, text AS seen FROM documents), {_snippet_sql('src', 3, 'ere', 40)} SELECT doc_id, snips AS snippets FROM snips")
def snippets(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    shown = tx.snippets(F.col("text"), "ERE", window=40)
    return docs.select("doc_id", F.concat_ws(" ¦ ", shown).alias("snippets"))


@query(f"SELECT conv_id, turn, {_count('text', 'aa')} AS aa, {_count('text', 'the')} AS the FROM conversations")
def match_count(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn",
        tx.count_matches(F.col("text"), "aa").alias("aa"), tx.count_matches(F.col("text"), "The").alias("the"),
    )
