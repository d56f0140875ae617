"""Quality rules: a decision list learned from labelled statistics, emitted as one ordered conditional expression.

Sequential covering: a rule is a conjunction of thresholds on the statistics of a text. It grows on two thirds of the
labelled rows by the condition with the most information gained about bad rows, is pruned to the prefix that does best on the
other third, and takes the rows it matches out of play; then the next rule grows. Only counts by statistic, bin and
label reach the driver, a few hundred numbers a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import let
from marginalia.llm.common import written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
GRAM = 8
#: Labelled rows that a list is learned from, at most.
MAX_LABELLED = 200_000

#: The statistics that rules may use; all are shares or means, so that long and short texts compare.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "fresh_words": "n_distinct / greatest(n_words, 1)",
}


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of ``GRAM`` words found at least twice in the list."""

    def spots(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        twin = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (ordered[F.greatest(k - 1, F.lit(0))]["h"] == ordered[k]["h"]))
            | ((k < last) & (ordered[F.least(k + 1, last)]["h"] == ordered[k]["h"])),
        )
        return F.sort_array(F.transform(twin, lambda k: ordered[k]["i"]))

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-GRAM).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts, zero,
            lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(GRAM))).cast("long").alias("n")),
            lambda acc: acc["n"],
        )

    def repeated(hashes: Column) -> Column:
        # Few texts hold a repeated window, and a set of hashes tells; only those are sorted.
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        found = let(F.sort_array(placed), lambda ordered: let(spots(ordered), covered))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - GRAM + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(GRAM))))
    return F.when(F.size(words) >= GRAM, let(hashes, repeated)).otherwise(F.lit(0).cast("long"))


def _statistics(text: Column) -> Column:
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BLANKS, "") != "")

    def build(pair: Column) -> Column:
        w, found = pair["w"], pair["l"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(found).cast("long").alias("n_lines"),
            _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
            _count(text, "0123456789").alias("n_digits"),
            _count(text, "!?;:,.-_=~^").alias("n_marks"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    return let(F.struct(words.alias("w"), lines.alias("l")), build)


def text_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """``docs`` with a struct of counts over each whole text; a null text counts as empty. Nothing is shuffled.

    Windows of words are compared by 64-bit hashes within one text.
    """
    return docs.withColumn(out_col, _statistics(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def base_failed(stats: Column) -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction; a text that meets one is rejected by it, all others are kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self, features: dict[str, Column]) -> Column:
        """Number of the first rule that holds, from 1, else null."""
        chosen = F.lit(None).cast("int")
        for i in range(len(self.rules) - 1, -1, -1):
            chosen = F.when(_all(self.rules[i], features), F.lit(i + 1)).otherwise(chosen)
        return chosen

    def __str__(self) -> str:
        return "; ".join(
            " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in self.rules
        )


def _all(rule: list[Condition], features: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.holds(features) for c in rule), F.lit(True))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    if p == 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(
    labelled: DataFrame,
    label_col: str = "bad",
    key_col: str = "doc_id",
    max_labelled: int = MAX_LABELLED,
    bins: int = 32,
    max_rules: int = 12,
    max_conditions: int = 4,
    least_cover: int = 4,
    least_precision: float = 0.95,
) -> DecisionList:
    """Learn a decision list from rows with the columns of ``FEATURES``, ``label_col`` (boolean) and ``key_col``.

    At most about ``max_labelled`` rows are used, chosen by a hash of the key. Rows whose label is null are skipped; with
    no bad row the list is empty and rejects nothing.
    """
    names = list(FEATURES)
    rows = labelled.where(F.col(label_col).isNotNull()).select(
        *[F.col(n).cast("double").alias(n) for n in names], F.col(label_col).alias("bad"),
        F.pmod(F.xxhash64(F.col(key_col), F.lit(17)), F.lit(3)).alias("fold"),
        F.pmod(F.xxhash64(F.col(key_col), F.lit(5)), F.lit(1 << 30)).alias("draw"),
    )
    rows = written(rows, "labelled")
    total = rows.count()
    if total > max_labelled:
        rows = rows.where(F.col("draw") < int((1 << 30) * max_labelled / total))
    # Thresholds: quantiles among bad rows and among good ones, so that a rare kind of either has its own.
    cuts: dict[str, list[float]] = {}
    shares = [i / bins for i in range(bins + 1)]
    for row in rows.groupBy("bad").agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).collect():
        for n in names:
            cuts[n] = sorted({*cuts.get(n, []), *(row[n] or [])})

    # One row for each statistic: its bin is the number of thresholds below the value.
    def bin_of(n: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts.get(n, [])]), lambda c: c < F.col(n))).alias(f"b_{n}")

    binned = written(rows.select("bad", "fold", *names, *[bin_of(n) for n in names]), "bins")
    plain = {n: F.col(n) for n in names}
    rules: list[list[Condition]] = []
    left = binned
    while len(rules) < max_rules:
        rule: list[Condition] = []
        held: list[tuple[int, int]] = []
        before: tuple[int, int] | None = None
        while len(rule) < max_conditions:
            pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"b_{n}").alias("b")) for n in names]))
            counts = (
                left.where(_all(rule, plain)).select("bad", (F.col("fold") == 0).alias("prune"), pairs.alias("at"))
                .groupBy("at.n", "at.b", "prune").agg(
                    F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("m"))
                .collect()
            )
            best = None
            for n in names:
                by: dict[bool, dict[int, tuple[int, int]]] = {False: {}, True: {}}
                for r in counts:
                    if r["n"] == n:
                        by[r["prune"]][r["b"]] = (r["p"], r["m"])
                all_p, all_m = (sum(v[i] for v in by[False].values()) for i in (0, 1))
                pr_p, pr_m = (sum(v[i] for v in by[True].values()) for i in (0, 1))
                if before is None and n == names[0] and all_p == 0:
                    return DecisionList(rules)
                if before is None:
                    before = (all_p, all_m)
                p = m = q = s = 0
                for b, cut in enumerate(cuts.get(n, [])):
                    p, m = p + by[False].get(b, (0, 0))[0], m + by[False].get(b, (0, 0))[1]
                    q, s = q + by[True].get(b, (0, 0))[0], s + by[True].get(b, (0, 0))[1]
                    for above, (cp, cm), prune in (
                        (False, (p, m), (q, s)), (True, (all_p - p, all_m - m), (pr_p - q, pr_m - s))
                    ):
                        if cp >= least_cover:
                            gain = _gain(cp, cm, *before)
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, Condition(n, above, cut), (cp, cm), prune)
            if best is None:
                break
            rule.append(best[1])
            held.append(best[3])
            before = best[2]
            if before[1] == 0:
                break
        if not rule:
            break
        # Prune: the prefix with the best share on the rows held back; the shorter one if equal.
        worth = [(p - m) / (p + m) if p + m else -1.0 for p, m in held]
        length = max(range(len(rule)), key=lambda i: (worth[i], -i)) + 1
        p, m = held[length - 1]
        if p + m == 0 or p / (p + m) < least_precision:
            break
        rules.append(rule[:length])
        left = left.where(~_all(rule[:length], plain))
    return DecisionList(rules)


def _with_features(docs: DataFrame) -> DataFrame:
    flat = docs.select("*", "stats.*")
    return flat.select("*", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its key as ``doc_id``, its counts and the ``FEATURES``, written once."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    stats = text_statistics(narrow).select("doc_id", "stats")
    # The struct is built once for each row; the features are read off the written table.
    return _with_features(written(stats, "statistics"))


def judged(stats: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, DecisionList]:
    """The rows of ``statistics_table`` with base_failed, rule (number or null) and kept; and the list learned.

    ``labels`` has doc_id and quality (0 is bad). Rows that fail the base rules take no part in learning.
    """
    marked = stats.withColumn("base_failed", base_failed(F.col("stats")))
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad"))
    learned = learn_rules(marked.where(~F.col("base_failed")).join(known, "doc_id"), **options)
    rule = learned.fired({n: F.col(n) for n in FEATURES})
    verdict = marked.withColumn("rule", rule)
    return verdict.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), learned


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that neither the base rules nor the learned list reject.

    Null and empty texts fail the base rules. Repeated rows share one fate. An empty table gives an empty one. The list is learned first,
    from the statistics of labelled documents alone; at most about ``max_labelled`` (200,000) labels are used, chosen by a hash.
    """
    most = options.get("max_labelled", MAX_LABELLED)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    total = known.count()
    if total > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * most / total))
    # Their number is bounded, so the texts need no exchange.
    named = F.broadcast(known.select(F.col("doc_id").alias("_labelled")).distinct())
    labelled = docs.join(named, F.col(f"`{id_col}`") == F.col("_labelled"), "left_semi")
    _, learned = judged(statistics_table(labelled, id_col, text_col), known, **options)
    stats = _statistics(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))

    def good(s: Column) -> Column:
        counts = {n: s[n] for n in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits",
            "n_marks", "n_distinct")}
        return ~base_failed(s) & learned.fired(_features(counts)).isNull()

    return docs.where(let(stats, good))


def _features(c: dict[str, Column]) -> dict[str, Column]:
    """``FEATURES`` over columns that lie inside a struct."""
    words, lines, chars = (F.greatest(c[n], F.lit(1)) for n in ("n_words", "n_lines", "word_chars"))
    return {
        "mean_word": c["word_chars"] / words, "symbols": c["n_symbols"] / words, "dup_lines": c["n_dup_lines"] / lines,
        "repeats": c["n_repeat_words"] / words, "capitals": c["n_capitals"] / chars, "digits": c["n_digits"] / chars,
        "marks": c["n_marks"] / words, "words_a_line": c["n_words"] / lines, "fresh_words": c["n_distinct"] / words,
    }
