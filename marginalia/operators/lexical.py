"""Scan search: substring, regular expression and fuzzy, with counts and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import listing

MODES = ("substring", "regex")
# Fixed value: what a locked hit shows instead of a snippet.
LOCKED_SNIPPET = "[locked — title matched; body encrypted]"


def _readable(search_body: bool) -> Column:
    """Body as far as the search may look: blank when locked or not asked for."""
    if not search_body:
        return F.lit("")
    return F.coalesce(F.when(~F.col("locked"), F.col("body")), F.lit(""))


def match_notes(
    notes: DataFrame,
    query: str,
    mode: str = "substring",
    fuzzy: bool = False,
    search_body: bool = True,
    require_all: bool = False,
    title_stands_in: bool = False,
) -> DataFrame:
    """Matching notes with ``score``, ``highlight`` and ``match_count``.

    ``title_stands_in`` reads the title in place of a body that does not hold the query itself, so a
    hit in the title alone counts twice; by default title and body are read once each.
    """
    query = query.strip()
    if mode not in MODES:
        raise ValueError(f"invalid mode: {mode!r}. Supported: 'substring', 'regex'.")
    tokens = tx.tokenize(query) if fuzzy else []
    if not query or (fuzzy and not tokens):
        return _empty(notes)
    # What a note must hold somewhere to become a candidate.
    pool = tx.selective_token(tokens) if fuzzy else ("" if mode == "regex" else query)

    title, body = F.coalesce(F.col("title"), F.lit("")), _readable(search_body)
    if pool:
        low = F.lit(pool.lower())
        in_body = F.contains(F.lower(body), low)
        candidate = F.contains(F.lower(title), low) | in_body
    else:
        in_body, candidate = F.lit(True), F.lit(True)
    if title_stands_in:
        body = F.when(in_body & (body != ""), body).otherwise(title)
    rows = notes.where(candidate).withColumn("_title", title).withColumn("_body", body)
    hay = F.concat_ws("\n", F.col("_title"), F.col("_body"))

    if fuzzy:
        score = tx.fuzzy_score(tokens, F.col("_title"), F.col("_body"))
        rows = rows.withColumn("score", score).where(F.col("score") > 0)
        if require_all:
            for token in sorted(set(tokens)):
                rows = rows.where(tx.contains_ci(hay, token))
        rows = rows.withColumn("highlight", F.lit(pool))
    elif mode == "regex":
        rows = rows.withColumn("highlight", tx.regex_first_match(hay, query))
        rows = rows.where(F.col("highlight").isNotNull()).withColumn("score", F.lit(1.0))
        rows = rows.withColumn("highlight", F.coalesce(F.nullif("highlight", F.lit("")), F.lit(query)))
    else:
        rows = rows.withColumn("score", F.lit(1.0)).withColumn("highlight", F.lit(query))

    counted = F.when(F.col("locked"), F.col("_title")).otherwise(hay)
    return rows.withColumn("match_count", tx.count_matches(counted, F.col("highlight"))).drop("_title", "_body")


def _empty(notes: DataFrame) -> DataFrame:
    return notes.where(F.lit(False)).select(
        "*",
        F.lit(0.0).alias("score"),
        F.lit("").alias("highlight"),
        F.lit(0).cast("bigint").alias("match_count"),
    )


def ranking() -> list[Column]:
    return [F.col("score").desc(), F.col("modified").desc_nulls_last(), F.col("pk")]


def after(hits: DataFrame, last: dict | None) -> DataFrame:
    """Hits that come after ``last`` in the ranking, with its key (``worse, late, pk``) as columns; all of them without one."""
    keyed = hits.withColumn("worse", -F.col("score").cast("double")).withColumn("late", listing.late())
    return keyed.where(listing.behind(last, "worse", "late", "pk"))


def with_snippets(rows: DataFrame, search_body: bool = True) -> DataFrame:
    """Highlighted windows; meant for a page of results, so it comes after the limit."""
    body = _readable(search_body)
    source = F.when(body != "", body).otherwise(F.col("title"))
    shown = tx.snippets(source, F.col("highlight"))
    locked = F.array(F.lit(LOCKED_SNIPPET))
    return rows.withColumn("snippets", F.when(F.col("locked"), locked).otherwise(shown))
