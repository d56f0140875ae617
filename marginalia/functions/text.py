"""Counting, highlighting and token arithmetic on text columns."""

from __future__ import annotations

import re

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.exprs import as_col, collapse_spaces, let

ELLIPSIS = "…"


def contains_ci(text: Column, needle: Column | str) -> Column:
    return F.contains(F.lower(text), F.lower(as_col(needle)))


def count_matches(text: Column, needle: Column | str) -> Column:
    """Non-overlapping, case-insensitive occurrences; 0 for an empty needle or text."""
    hay, low = F.lower(text), F.lower(as_col(needle))
    removed = F.length(hay) - F.length(F.replace(hay, low, F.lit("")))
    hits = F.when(F.length(low) > 0, (removed / F.length(low)).cast("bigint"))
    return F.coalesce(hits, F.lit(0).cast("bigint"))


def _window(text: Column, start: Column, end: Column) -> Column:
    """Text between two 0-based offsets on one line, with ellipses where cut."""
    body = collapse_spaces(F.substring(text, start + 1, end - start))
    left = F.when(start > 0, ELLIPSIS).otherwise("")
    right = F.when(end < F.length(text), ELLIPSIS).otherwise("")
    return F.concat(left, body, right)


def snippets(text: Column, needle: Column | str, window: int = 100, max_spans: int = 3) -> Column:
    """Up to ``max_spans`` windows around the matches of ``needle``.

    Two windows lie at least ``window`` characters apart, so after a window that ends at ``e`` the
    next match cannot start before ``e + 2 * window``: one ``position`` call per span is enough.
    """
    window = max(0, window)
    query = as_col(needle)
    if max_spans < 1:
        return F.array().cast("array<string>")
    low_text, low_query = F.lower(text), F.lower(query)

    def start_of(hit: Column) -> Column:
        return F.greatest(F.lit(0), hit - 1 - window)

    def end_of(hit: Column) -> Column:
        return F.least(F.length(text), hit - 1 + F.length(query) + window)

    def extend(hits: Column, _: Column) -> Column:
        last = F.element_at(hits, -1)
        following = F.position(low_query, low_text, end_of(last) + 2 * window + 1)
        return F.when(last == 0, hits).otherwise(F.concat(hits, F.array(following)))

    first = F.array(F.position(low_query, low_text))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(max_spans - 1)), first, extend) if max_spans > 1 else first
    spans = F.transform(F.filter(found, lambda h: h > 0), lambda h: _window(text, start_of(h), end_of(h)))
    # Without a match the opening of the text stands in.
    opening = F.concat(
        collapse_spaces(F.substring(text, 1, 2 * window)),
        F.when(F.length(text) > 2 * window, ELLIPSIS).otherwise(""),
    )
    if window:
        spans = let(spans, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(opening)))
    empty = F.array().cast("array<string>")
    blank = text.isNull() | (text == "") | query.isNull() | (query == "")
    return F.when(blank, empty).otherwise(spans)


def tokenize(query: str) -> list[str]:
    """Search words of a query: lower case, two characters or more."""
    return [word for word in query.lower().split() if len(word) > 1]


def selective_token(tokens: list[str]) -> str:
    """The longest token, the earliest of equals."""
    return max(tokens, key=len, default="")


def fuzzy_score(tokens: list[str], title: Column, body: Column) -> Column:
    """Share of query words found plus half the share found in the title."""
    if not tokens:
        return F.lit(0.0)
    zero = F.lit(0)
    low_title, low_body = F.lower(title), F.lower(body)
    found = sum(
        ((F.contains(low_title, F.lit(t)) | F.contains(low_body, F.lit(t))).cast("int") for t in sorted(set(tokens))),
        zero,
    )
    in_title = sum((F.contains(low_title, F.lit(t)).cast("int") for t in tokens), zero)
    n = float(len(tokens))
    return found / F.lit(n) + F.lit(0.5) * (in_title / F.lit(n))


# Constructs that Java's regular expressions lack or read differently.
_FOREIGN = re.compile(r"\(\?\(|\(\?P[^<=]|\(\?[a-zA-Z]*[aLu]|\\Z|\\N\{|&&|\[[^\]\\]*\[|\\[0-7]{3}|--")


def java_pattern(pattern: str) -> str | None:
    """``pattern`` for ``rlike`` with case folding, or null where the engines differ."""
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"invalid regex: {exc}") from exc
    if _FOREIGN.search(pattern):
        return None
    # Java group names take no underscore.
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", named)
    named = "(?iudU)" + named
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(named)
    except Py4JJavaError:
        return None
    return named


def _python_search(pattern: str):
    @F.pandas_udf("string")
    def search(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, re.IGNORECASE)
        hits = (compiled.search(t) if t is not None else None for t in texts)
        return pd.Series([h.group(0) if h else None for h in hits], dtype="object")

    return search


def regex_first_match(text: Column, pattern: str) -> Column:
    """First match of a case-insensitive pattern, null where there is none."""
    java = java_pattern(pattern)
    if java is None:
        return _python_search(pattern)(text)
    return F.when(F.rlike(text, F.lit(java)), F.regexp_extract(text, java, 0))
