"""Find pattern matches with code-point positions in column expressions.

Spark has functions for the texts between matches (``split``) and for the matches (``regexp_extract_all``); the running
length of both gives the positions. Positions count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.exprs import let

#: Matches per block of the running sum, so that long lists cost no quadratic copying.
BLOCK = 128
#: Code points of context kept on either side of a match.
CONTEXT = 48

FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _running(items: Column) -> Column:
    """Add ``start`` and ``end`` to structs with ``gap`` and ``value``, in two levels."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)),
    )

    def place(block: Column, offset: Column) -> Column:
        zero = F.struct(offset.alias("at"), F.expr(f"cast(array() as {FOUND})").alias("out"))

        def step(acc: Column, item: Column) -> Column:
            start = acc["at"] + item["gap"]
            end = start + F.length(item["value"])
            one = F.struct(
                start.alias("start"), end.alias("end"), item["value"].alias("value"),
                item["before"].alias("before"), item["after"].alias("after"),
            )
            return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda acc, item: acc + item["gap"] + F.length(item["value"]))

    def offsets(found: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(
            F.transform(found, total), zero,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"],
        )

    return let(blocks, lambda found: F.flatten(F.zip_with(found, offsets(found), place)))


def find_all(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in a non-null text; it must not match the empty string.

    ``needs`` is a cheap pattern without which there is no match; such texts skip the work.
    """
    none = F.expr(f"cast(array() as {FOUND})")

    def zipped(pair: Column) -> Column:
        parts, hits = pair["parts"], pair["hits"]
        items = F.transform(
            hits,
            lambda hit, i: F.struct(
                F.length(parts[i]).alias("gap"), hit.alias("value"),
                F.right(parts[i], F.lit(CONTEXT)).alias("before"), F.left(parts[i + 1], F.lit(CONTEXT)).alias("after"),
            ),
        )
        return let(items, _running)

    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))
    hit = F.when(text.rlike(pattern), let(both, zipped)).otherwise(none)
    return hit if needs is None else F.when(text.rlike(needs), hit).otherwise(none)


def labelled(found: Column, kind: str, order: int, score: Column | float = 1.0) -> Column:
    """Matches as spans of one kind; ``order`` decides between spans with one start."""
    return F.transform(
        found,
        lambda hit: F.struct(
            hit["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), hit["end"].alias("end"),
            hit["value"].alias("value"), (score(hit) if callable(score) else F.lit(float(score))).alias("score"),
        ),
    )


def merged(spans: Sequence[Column]) -> Column:
    """Spans of several kinds by start, then kind."""
    return F.sort_array(F.concat(*spans))


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
