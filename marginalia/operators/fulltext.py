"""Full-text search: an inverted index with positions, BM25 and excerpts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.exprs import let
from marginalia.functions.terms import WORD, kept_letters, with_terms, words, words_like
from marginalia.session import stored
from marginalia.sources.layout import spread, spread_by

TITLE_WEIGHT, BODY_WEIGHT = 5.0, 1.0
K1, B = 1.2, 0.75
# Weight of a term that occurs in more than half of all notes.
LEAST_IDF = 1e-6
EXCERPT_WORDS = 40
MARK_OPEN, MARK_CLOSE, GAP = ">>>", "<<<", "..."

TITLE, BODY = 0, 1
#: Bytes of input whose words one task counts: the counts of a task stay in memory, at about a hundred times that.
COUNT_BYTES = 2 << 20

_PLAIN = re.compile(r"[\w\s*]+")
_OPERATORS = re.compile(r"\b(?:AND|OR|NOT|NEAR)\b")
_QUERY_WORD = re.compile(r"[^\W_]+")


# -- queries -----------------------------------------------------------------


def escape_query(query: str) -> str:
    """Leave plain words and prefixes alone; quote everything else as one phrase."""
    if not query or (_PLAIN.fullmatch(query) and not _OPERATORS.search(query)):
        return query
    doubled = query.replace('"', '""')
    return f'"{doubled}"'


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False


def parse_query(spark: SparkSession, query: str) -> list[Phrase]:
    """Phrases that must all occur; empty for a query without words or with a stray star."""
    escaped = escape_query(query.strip())
    if escaped.startswith('"'):
        raw = [(query, False)]
    else:
        spaced = re.sub(r"\s+\*", "*", escaped)
        raw = [(part, bool(star)) for part, star in re.findall(r"([^\s*]*)(\*?)", spaced) if part or star]
    spellings = [_QUERY_WORD.findall(part.lower()) for part, _ in raw]
    if any(not part for part, _ in raw):
        return []
    terms = _terms(spark, tuple(sorted({w for s in spellings for w in s})))
    phrases = [Phrase(tuple(terms[w] for w in s), star) for s, (_, star) in zip(spellings, raw) if s]
    return list(phrases)


@lru_cache(maxsize=256)
def _terms(spark: SparkSession, spellings: tuple[str, ...]) -> dict[str, str]:
    if not spellings:
        return {}
    rows = spark.createDataFrame([(w,) for w in spellings], "word string")
    return {r["word"]: r["term"] for r in with_terms(rows, "word").collect()}


# -- index -------------------------------------------------------------------


def _split(nodes: DataFrame, how: Callable[[Column], Column] = words) -> DataFrame:
    """``node_id, length, _t, _b`` from ``id, title, body``: the words of title and body in order."""
    rows = nodes.select(F.col("id").alias("node_id"), how(F.col("title")).alias("_t"), how(F.col("body")).alias("_b"))
    return rows.select("node_id", (F.size("_t") + F.size("_b")).alias("length"), "_t", "_b")


def _spelled(found: Column) -> Column:
    """Each different word of an array with its places, as ``(word, at)``: sorted by word, runs of equal words cut apart."""

    def cut(pairs: Column) -> Column:
        def fresh(k: Column) -> Column:
            return (k == 0) | (F.get(pairs, k)["word"] != F.get(pairs, k - 1)["word"])

        def runs(firsts: Column) -> Column:
            def run(first: Column, i: Column) -> Column:
                size = F.coalesce(F.get(firsts, i + 1), F.size(pairs)) - first
                at = F.transform(F.slice(pairs, first + 1, size), lambda p: p["at"])
                return F.struct(F.get(pairs, first)["word"].alias("word"), at.alias("at"))

            return F.transform(firsts, run)

        places = F.filter(F.sequence(F.lit(0), F.size(pairs)), lambda k: k < F.size(pairs))
        return let(F.filter(places, fresh), runs)

    # Unlike array_sort, sort_array compares without a lambda function.
    return let(F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("word"), i.alias("at")))), cut)


def build_postings(nodes: DataFrame) -> DataFrame:
    """``term, node_id, length, title_at, body_at`` from ``id, title, body``.

    Spellings are grouped within the row, before their terms are derived, so each is stemmed once per node. What is then
    grouped by term stays within the node and adds no exchange.
    """
    rows = _split(spread_by(nodes.select("id", "title", "body"), "id"))
    # Places in the title are counted from the front, those in the body from its end.
    rows = rows.select("node_id", "length", F.size("_t").alias("_titled"), F.inline(_spelled(F.concat("_t", "_b"))))
    grouped = with_terms(rows, "word").groupBy("node_id", "length", "_titled", "term").agg(F.collect_list("at").alias("_at"))
    grouped = grouped.withColumn("_at", F.when(F.size("_at") == 1, F.get("_at", F.lit(0))).otherwise(F.sort_array(F.flatten("_at"))))
    titled = F.filter("_at", lambda a: a < F.col("_titled"))
    body = F.transform(F.filter("_at", lambda a: a >= F.col("_titled")), lambda a: a - F.col("_titled"))
    return grouped.select("node_id", "length", "term", titled.alias("title_at"), body.alias("body_at"))


def _kept(nodes: DataFrame, phrases: list[Phrase], positions: bool) -> DataFrame:
    """``node_id, length, kept`` of every note: its words that can match, as ``(column, at, word)``; the others are dropped within the row."""
    starts = sorted({kept_letters(t) for p in phrases for t in p.terms})

    def fitting(name: str, column: int) -> Column:
        # Words that cannot match are empty strings, so places and lengths stay.
        def entry(at: Column, word: Column) -> Column:
            return F.struct(F.lit(column).alias("column"), at.alias("at"), word.alias("word"))

        if not positions:
            return F.transform(F.array_remove(name, ""), lambda w: entry(F.lit(None).cast("int"), w))
        places = F.filter(F.sequence(F.lit(0), F.size(name)), lambda i: F.get(name, i) != "")
        return F.transform(places, lambda i: entry(i, F.get(name, i)))

    rows = _split(spread(nodes.select("id", "title", "body")), lambda text: words_like(text, starts))
    return rows.select("node_id", "length", F.concat(fitting("_t", TITLE), fitting("_b", BODY)).alias("kept"))


def _positions(phrases: list[Phrase]) -> bool:
    return any(len(p.terms) > 1 for p in phrases)


def _kept_postings(kept: DataFrame, phrases: list[Phrase], positions: bool) -> DataFrame:
    rows = with_terms(kept.select("node_id", "length", F.inline("kept")), "word")
    if not positions:
        counts = [F.count(F.when(F.col("column") == c, 1)).alias(n) for c, n in ((TITLE, "title_n"), (BODY, "body_n"))]
        return rows.groupBy("node_id", "length", "term").agg(*counts)
    at = [F.array_sort(F.collect_list(F.when(F.col("column") == c, F.col("at")))).alias(n) for c, n in ((TITLE, "title_at"), (BODY, "body_at"))]
    return rows.where(_wanted(phrases)).groupBy("node_id", "length", "term").agg(*at)


def postings_for(nodes: DataFrame, query: str) -> DataFrame:
    """Postings of the words that can match a query, for a search without a stored index.

    A query of single words needs no positions, so its postings hold counts, ``title_n, body_n``.
    """
    phrases = parse_query(nodes.sparkSession, query)
    positions = _positions(phrases)
    return _kept_postings(_kept(nodes, phrases, positions), phrases, positions)


def searchable(nodes: DataFrame, query: str, positions: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`postings_for` and :func:`build_stats` from one reading of the notes; with ``positions`` as :func:`build_postings` has them.

    What is kept of each note, its length and the words that can match, is stored.
    """
    phrases = parse_query(nodes.sparkSession, query)
    positions = positions or _positions(phrases)
    kept = stored(_kept(nodes, phrases, positions), "kept")
    stats = kept.agg(F.count("*").alias("notes"), F.avg("length").alias("mean_length"))
    return _kept_postings(kept, phrases, positions), stats


def build_stats(nodes: DataFrame) -> DataFrame:
    """One row: number of notes and their mean length in words."""
    length = F.size(words(F.col("title"))) + F.size(words(F.col("body")))
    return spread(nodes.select("title", "body")).agg(F.count("*").alias("notes"), F.avg(length).alias("mean_length"))


def count_terms(nodes: DataFrame) -> DataFrame:
    """:func:`term_stats` of notes without postings: only counts are kept, which hash aggregation holds in place."""
    rows = _split(spread_by(nodes.select("id", "title", "body"), "id", COUNT_BYTES)).select("node_id", F.explode(F.concat("_t", "_b")).alias("word"))
    spelled = with_terms(rows.groupBy("node_id", "word").agg(F.count("*").alias("uses")), "word")
    own = spelled.groupBy("node_id", "term").agg(F.sum("uses").alias("uses"))
    return own.groupBy("term").agg(F.count("*").alias("notes"), F.sum("uses").alias("uses"))


def term_stats(postings: DataFrame) -> DataFrame:
    """Notes and occurrences per term."""
    uses = F.size("title_at") + F.size("body_at")
    return postings.groupBy("term").agg(
        F.count("*").alias("notes"), F.sum(uses).cast("bigint").alias("uses")
    )


# -- matching ----------------------------------------------------------------


def _slots(phrases: list[Phrase]) -> Column:
    """The places in the query that a term can fill, as ``(phrase, step)`` pairs."""
    places = []
    for number, phrase in enumerate(phrases):
        for step, term in enumerate(phrase.terms):
            partial = phrase.prefix and step == len(phrase.terms) - 1
            fits = F.col("term").startswith(term) if partial else F.col("term") == term
            places.append(F.when(fits, F.struct(F.lit(number).alias("phrase"), F.lit(step).alias("step"))))
    return F.array_compact(F.array(*places))


def _wanted(phrases: list[Phrase]) -> Column:
    """Filter on ``term`` alone, for the scan of the stored index."""
    exact = sorted({t for p in phrases for i, t in enumerate(p.terms) if not (p.prefix and i == len(p.terms) - 1)})
    tests = [F.col("term").isin(exact)] if exact else []
    tests += [F.col("term").startswith(p.terms[-1]) for p in phrases if p.prefix]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _occurrences(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """``node_id, length, phrase, column, start``: where each phrase begins."""
    rows = postings.where(_wanted(phrases)).select("node_id", "length", "title_at", "body_at", F.inline(_slots(phrases)))

    def starts(name: str, column: int) -> Column:
        return F.transform(name, lambda at: F.struct(F.lit(column).alias("column"), (at - F.col("step")).alias("start")))

    rows = rows.select(
        "node_id", "length", "phrase", "step", F.inline(F.concat(starts("title_at", TITLE), starts("body_at", BODY)))
    ).repartition("node_id")
    if all(len(p.terms) == 1 for p in phrases):
        return rows.drop("step")
    wanted = F.element_at(F.array(*[F.lit(len(p.terms)) for p in phrases]), F.col("phrase") + 1)
    complete = rows.groupBy("node_id", "length", "phrase", "column", "start").agg(F.countDistinct("step").alias("steps"))
    return complete.where(F.col("steps") == wanted).drop("steps")


def _frequencies(postings: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """``node_id, length, phrase, f``: weighted frequency of each phrase in each note."""
    weight = {TITLE: TITLE_WEIGHT, BODY: BODY_WEIGHT}
    if all(len(p.terms) == 1 for p in phrases):
        # Single words need counts only, not positions.
        counted = "title_n" in postings.columns
        in_title, in_body = (F.col("title_n"), F.col("body_n")) if counted else (F.size("title_at"), F.size("body_at"))
        rows = postings.where(_wanted(phrases)).select(
            "node_id", "length",
            (in_title * weight[TITLE] + in_body * weight[BODY]).alias("part"),
            F.inline(_slots(phrases)),
        ).repartition("node_id")
        return rows.groupBy("node_id", "length", "phrase").agg(F.sum("part").alias("f"))
    value = F.when(F.col("column") == TITLE, weight[TITLE]).otherwise(weight[BODY])
    return _occurrences(postings, phrases).groupBy("node_id", "length", "phrase").agg(F.sum(value).alias("f"))


def search(postings: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """``node_id, score`` of the notes that hold every word or phrase of the query.

    The table of document frequencies has one row per phrase of the query, which bounds the broadcast.
    """
    spark = postings.sparkSession
    phrases = parse_query(spark, query)
    if not phrases:
        return spark.createDataFrame([], "node_id string, score double")
    # One shuffle of the matches, by note, serves their grouping, the document frequencies and the scores.
    found = _frequencies(postings, phrases)
    hits = F.sum(F.when(F.col("f") + F.col("length") > 0, 1)).alias("hits")
    notes = stats.select("notes").scalar()
    mean = stats.select("mean_length").scalar()
    raw_idf = F.log((notes - F.col("hits") + 0.5) / (F.col("hits") + 0.5))
    idf = found.groupBy("phrase").agg(hits).select(
        "phrase", F.when(raw_idf > 0, raw_idf).otherwise(F.lit(LEAST_IDF)).alias("idf")
    )
    f = F.col("f")
    part = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / mean))
    scored = found.join(F.broadcast(idf), "phrase").groupBy("node_id").agg(
        F.sum(part).alias("score"), F.count("*").alias("present")
    )
    return scored.where(F.col("present") == len(phrases)).select("node_id", "score")


def best_first() -> list[Column]:
    """Order of hits. Copies of a note score alike but for the order of a sum, so the last digits do not count."""
    return [F.round("score", 12).desc(), F.col("node_id")]


def top(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return scored.orderBy(*best_first()).offset(offset).limit(limit)


# -- excerpts ----------------------------------------------------------------


def with_excerpts(hits: DataFrame, nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Add ``excerpt`` to at most ``limit`` hits: the 40 words of the body that show most of the query.

    How the hits meet the notes is left to Spark, which knows their size.
    """
    spark = hits.sparkSession
    phrases = parse_query(spark, query)
    page = hits.limit(limit)
    texts = nodes.select(F.col("id").alias("node_id"), "title", "body").join(page, "node_id")
    local = build_postings(texts.select(F.col("node_id").alias("id"), "title", "body"))
    spans = (
        _occurrences(local, phrases)
        .where(F.col("column") == BODY)
        .groupBy("node_id")
        .agg(F.array_sort(F.collect_list(F.struct("start", "phrase"))).alias("spans"))
    )
    sizes = F.array(*[F.lit(len(p.terms)) for p in phrases])
    rows = texts.join(spans, "node_id", "left")
    body = F.coalesce(F.col("body"), F.lit(""))
    none = F.array().cast("array<struct<start:int,phrase:int>>")
    excerpt = let(
        F.coalesce(F.col("spans"), none),
        lambda s: let(
            F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
            lambda w: let(F.split(body, WORD, -1), lambda g: _excerpt(s, w, g, sizes)),
        ),
    )
    return rows.withColumn("excerpt", excerpt).drop("spans", "body")


def _window_score(spans: Column, first: Column) -> Column:
    inside = F.filter(spans, lambda s: (s["start"] >= first) & (s["start"] < first + EXCERPT_WORDS))
    kinds = F.size(F.array_distinct(F.transform(inside, lambda s: s["phrase"])))
    return F.size(inside) + kinds * 999


def _excerpt(spans: Column, found: Column, gaps: Column, sizes: Column) -> Column:
    total = F.size(found)
    # A sentence starts at the first word and after a full stop or colon and white space.
    opens = F.filter(
        F.transform(gaps, lambda g, i: F.when((i == 0) | ((i < total) & F.rlike(g, F.lit(r"[.:][ \t\n\r]+$"))), i)),
        lambda i: i.isNotNull(),
    )

    def option(score: Column, order: Column, start: Column) -> Column:
        return F.struct(score.alias("score"), (-order).alias("order"), start.alias("start"))

    def centred(span: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] >= span["start"]) & (s["start"] < span["start"] + EXCERPT_WORDS))
        last = F.element_at(inside, -1)
        slack = EXCERPT_WORDS - (last["start"] + F.element_at(sizes, last["phrase"] + 1) - span["start"])
        half = F.greatest(F.lit(0), F.floor(slack / 2).cast("int"))
        return F.greatest(F.lit(0), F.least(span["start"] - half, total - EXCERPT_WORDS))

    def options(span: Column, i: Column, heads: Column) -> Column:
        head = F.array_max(F.filter(heads, lambda h: h <= span["start"]))
        bonus = F.when(head == 0, 120).otherwise(100)
        sentence = F.when(
            (total > EXCERPT_WORDS) & (head < span["start"]),
            option(_window_score(spans, head) + bonus, i * 2 + 1, head),
        )
        return F.array(option(_window_score(spans, span["start"]), i * 2, centred(span)), sentence)

    best = let(opens, lambda heads: F.array_max(F.flatten(F.transform(spans, lambda s, i: options(s, i, heads)))))
    start = let(best, lambda o: F.coalesce(o["start"], F.lit(0)))

    def end_of(span: Column) -> Column:
        return span["start"] + F.element_at(sizes, span["phrase"] + 1)

    def word(k: Column, first: Column) -> Column:
        lit_up = F.exists(spans, lambda s: (s["start"] <= k) & (k < end_of(s)))
        begins = lit_up & ~F.exists(spans, lambda s: (s["start"] < k) & (k < end_of(s)))
        ends = lit_up & ~F.exists(spans, lambda s: (s["start"] <= k) & (k + 1 < end_of(s)))
        before = F.when((k > first) | (first == 0), F.get(gaps, k)).otherwise("")
        return F.concat(
            before, F.when(begins, MARK_OPEN).otherwise(""), F.get(found, k), F.when(ends, MARK_CLOSE).otherwise("")
        )

    def render(first: Column) -> Column:
        last = F.least(first + EXCERPT_WORDS, total) - 1
        shown = F.array_join(F.transform(F.sequence(first, last), lambda k: word(k, first)), "")
        tail = F.when(last < total - 1, GAP).otherwise(F.get(gaps, total))
        return F.concat(F.when(first > 0, GAP).otherwise(""), shown, F.coalesce(tail, F.lit("")))

    return F.when(total > 0, let(start, render)).otherwise("")
