"""URL rules by a sorted sweep: rules are intervals of reversed hosts, and a stack holds those open at the current URL.

The key of a host is its labels in reverse, each followed by a dot: ``com.example.www.``. All subdomains of ``example.com``
then lie between ``com.example.`` and ``com.example/``, and intervals of rules nest or are disjoint. URLs and rules are dealt
by key range to partitions; a rule goes to each range that its interval meets, so no partition needs what lies before it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import parallelism

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = -(1 << 63)
#: Keys drawn for each range when the bounds of the ranges are set; results do not depend on it.
DRAWN = 20


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """Stack of open rules while keys come in ascending order, rules before URLs of the same key."""

    def __init__(self) -> None:
        self.open: list[tuple[str, dict[str, tuple], list[int]]] = []

    def _close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def rule(self, key: str, path: str, text: str, verdict: str) -> None:
        self._close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, paths, lengths = self.open[-1]
        old = paths.get(path)
        if old is None or (old[1], verdict) == ("allow", "block"):
            paths[path] = (text, verdict)
        if old is None and len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits; between rules of equal length, the one with the longer host."""
        self._close(key)
        best: tuple = (-1, None, None)
        for _, paths, lengths in reversed(self.open):
            for n in lengths:
                hit = paths.get(path[:n]) if n <= len(path) else None
                if hit is not None:
                    if len(hit[0]) > best[0]:
                        best = (len(hit[0]), *hit)
                    break
        return best[1], best[2]


def judge_urls(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``urls``: its id, host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block); any number of rows. A rule fits its host and all subdomains if the
    path of the URL starts with the rule's. Where no rule fits, rule is null and the verdict is ``default``. Null URLs have
    an empty host and path. Of two verdicts for one host and path, block holds; rules with a null part are ignored.
    Repeated URLs, ids and null ids give one row each. An empty table gives an empty result.
    """
    spark = urls.sparkSession
    ranges = 2 * parallelism(spark)
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    keyed = urls.select(F.col(f"`{id_col}`").alias("id"), url_host(url).alias("host"), url_path(url).alias("path")).select(
        "*", host_key(F.col("host")).alias("key"), F.xxhash64("id", "path").alias("salt"))
    share = min(1.0, DRAWN * ranges / max(1, urls.count()))
    # The draw is by a hash that the salt does not share, and holds a number of keys set by the number of ranges.
    drawn = keyed.where(F.pmod(F.xxhash64("salt", "key"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1)
    points = sorted(tuple(r) for r in drawn.select("key", "path", "salt").limit(4 * DRAWN * ranges).collect())
    bounds = sorted({points[len(points) * i // ranges] for i in range(1, ranges)}) if points else []

    def deal_urls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["part"] = [bisect_right(bounds, t) for t in zip(b["key"], b["path"], b["salt"], strict=True)]
            yield b.assign(kind=1, rule="", verdict="")[order]

    def deal_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            first = [bisect_right(bounds, (k, "", LEAST)) for k in b["key"]]
            last = [bisect_right(bounds, (k[:-1] + "/", "", LEAST)) for k in b["key"]]
            b["part"] = [list(range(i, j + 1)) for i, j in zip(first, last, strict=True)]
            yield b.explode("part").astype({"part": "int32"}).assign(id=None, kind=0, salt=0)[order]

    order = ["part", "key", "kind", "path", "salt", "id", "host", "rule", "verdict"]
    id_type = keyed.schema["id"].dataType.simpleString()
    schema = f"part int, key string, kind int, path string, salt long, id {id_type}, host string, rule string, verdict string"
    known = rules.select("host", "path", "verdict").dropna().distinct().select(
        "*", host_key(F.col("host")).alias("key"), F.concat("host", "path").alias("rule"))
    events = keyed.mapInPandas(deal_urls, schema).unionByName(known.mapInPandas(deal_rules, schema))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = None, Sweep()
        for b in batches:
            found: list[tuple] = []
            for p, key, kind, path, rule, verdict in zip(
                b["part"], b["key"], b["kind"], b["path"], b["rule"], b["verdict"], strict=True
            ):
                if p != part:
                    part, state = p, Sweep()
                if kind == 0:
                    state.rule(key, path, rule, verdict)
                else:
                    found.append(state.judge(key, path))
            out = b.loc[b["kind"] == 1, ["id", "host", "path"]].reset_index(drop=True)
            out["rule"] = pd.Series([r for r, _ in found], dtype=object)
            out["verdict"] = pd.Series([v or default for _, v in found], dtype=object)
            yield out

    swept = events.repartition(parallelism(spark), "part").sortWithinPartitions("part", "key", "kind").mapInPandas(
        sweep, f"id {id_type}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)
