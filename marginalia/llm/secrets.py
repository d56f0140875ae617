"""Secrets: known shapes, plus strings whose characters are too evenly spread to be words.

For the latter, a window slides over each candidate string. Its Shannon entropy follows from S = sum(c log2 c) over the
counts c of its characters: H = log2(w) - S / w. One character enters and one leaves at each step, so S changes by the
two counts concerned. Each character class has its own threshold, and an allow-list suppresses harmless shapes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import let
from marginalia.llm.spans import find_all, labelled, merged

ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++"
)
VALUE = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)$"
ASSIGN_HEAD = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"

BASE_KINDS = ("assign", "access", "hex")
WINDOW = 20
#: Character class of a whole candidate, and the entropy in bits that its best window must reach.
CLASSES = (("^[0-9a-fA-F]+$", 3.2), ("^[A-Za-z0-9]+$", 3.6), ("^.*$", 3.7))
#: Candidates that look random but are not secrets: all one case of letters, plain numbers, UUIDs, paths and slugs.
ALLOWED = (
    r"^[a-z]+$", r"^[A-Z]+$", r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[/=_+-]?[A-Za-z]+(?:[/=_+-]+[A-Za-z]+)*+[/=_+-]*$", r"^.*?[=_-]{4}.*$", r"^//",
)


def window_entropy(value: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, of any window of ``width`` characters (of the whole if shorter)."""

    def f(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def count(chars: Column, c: Column) -> Column:
        return F.size(F.filter(chars, lambda x: x == c)).cast("double")

    def slide(chars: Column) -> Column:
        n = F.least(F.size(chars), F.lit(width))
        first = F.slice(chars, 1, n)
        start = F.aggregate(F.array_distinct(first), F.lit(0.0), lambda acc, c: acc + f(count(first, c)))
        zero = let(start, lambda s: F.struct(s.alias("now"), s.alias("least")))

        def step(acc: Column, i: Column) -> Column:
            # chars[i] enters and chars[i - width] leaves; both counts are taken among the characters that stay.
            stay = F.slice(chars, i - width + 2, F.lit(width - 1))

            def move(kept: Column) -> Column:
                enters, leaves = count(kept, chars[i]), count(kept, chars[i - width])
                now = acc["now"] + f(leaves) - f(leaves + 1) + f(enters + 1) - f(enters)
                return let(now, lambda s: F.struct(s.alias("now"), F.least(acc["least"], s).alias("least")))

            return let(stay, move)

        later = F.when(F.size(chars) > width, F.sequence(F.lit(width), F.size(chars) - 1)).otherwise(
            F.expr("cast(array() as array<int>)")
        )
        best = F.aggregate(later, zero, step, lambda acc: acc["least"])
        return F.log2(n.cast("double")) - best / n

    return let(F.split(value, "(?!^)(?!$)", -1), slide)


def _is_random(value: Column) -> Column:
    allowed = value.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    need = F.lit(math.inf)
    for pattern, bits in reversed(CLASSES):
        need = F.when(value.rlike(pattern), F.lit(bits)).otherwise(need)
    return F.when(allowed, False).otherwise(window_entropy(value) >= need)


def _spans(text: Column) -> Column:
    assign = F.filter(
        find_all(text, ASSIGN, r"[:=]"), lambda hit: F.length(F.regexp_replace(hit["value"], ASSIGN_HEAD, "")) >= 6
    )
    base = merged([
        labelled(assign, "assign", 1),
        labelled(find_all(text, ACCESS, "AKIA"), "access", 2),
        labelled(find_all(text, HEX), "hex", 3),
    ])

    def with_entropy(known: Column) -> Column:
        fresh = F.filter(
            find_all(text, CANDIDATE),
            lambda hit: _is_random(hit["value"])
            & ~F.exists(known, lambda s: (s["start"] < hit["end"]) & (hit["start"] < s["end"])),
        )
        return merged([known, labelled(fresh, "entropy", 4, lambda hit: window_entropy(hit["value"]))])

    return let(base, with_entropy)


def secret_spans(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` with ``out_col``: array of (start, order, kind, end, value, score), by start, then kind.

    Kinds: assign, access, hex, then entropy, which never overlaps the others; its score is the entropy in bits. A null
    text counts as empty. Rows are judged one by one, repeated ones too. A column called ``out_col`` is replaced.
    """
    return docs.withColumn(out_col, _spans(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
