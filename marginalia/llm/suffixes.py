"""Repeated byte strings by arrays of longest previous factors over a sparse suffix order.

Only matches of ``LEAST`` bytes or more matter. Every string of that length has an anchor: the position with the smallest hash
of ``GRAM`` bytes in it, which depends on nothing outside the string. Suffixes that share ``LEAST`` bytes therefore stand at the
same distance before equal anchors, so the suffixes of one anchor are put in lexicographic order among themselves, with no
order of the whole corpus: first the suffixes that start at the anchor, then, byte by byte to the left, those that start
before it, each order sorted from the last one by one byte. Common prefixes of neighbours follow from the last ones by minima
over ranges. In that order the previous and the next smaller position of a suffix, found with a stack, give its longest
previous factor; its neighbours give the longest match anywhere. Matches are measured up to ``LENGTH`` bytes.

Most suffixes never leave their text. The strings of one anchor in one text form a context; equal contexts are settled by
counting, and only differing contexts of one anchor are put in order.

An anchor with very many differing contexts is dealt out in pieces, by what follows it. Each piece is put in suffix order like a
whole anchor. What other pieces hold of the anchor shares no more with a context than the ends of its own piece do, and no more
than the context's neighbours in the orders of what precedes the anchor and of what follows. Only strings within these bounds
can occur in two pieces; each piece names such a string once, and these are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import numbered, written

LENGTH, LEAST, GRAM = 400, 256, 48
#: A repeated stretch of more words than this is a passage.
WORDS = 50
#: An anchor with more differing contexts than this is put in order in pieces.
CROWDED = 500
#: Bytes of contexts that are put in order at a time; no piece of a crowded anchor holds more.
BATCH = 2 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = 28  # bits of a position beside its hash; texts may have 256 MB


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on, by doubling; as long as there are such positions."""
    if len(data) < length:
        return np.array([], dtype=np.uint64)
    h, n = _mix(data.astype(np.uint64) + np.uint64(seed * 257 + 1)), 1
    while n < length:
        step = min(n, length - n)
        h = _mix(h[: len(h) - step] * _B + h[step:] + np.uint64(n))
        n += step
    return h


def contexts_of(data: np.ndarray, length: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last start of the strings of each anchor, in order, and the bytes from the first start to the anchor."""
    h = gram_hashes(data, gram)
    width = length - gram + 1
    if len(h) < width:
        none = np.array([], dtype=np.int64)
        return none, none, none, none
    least = ((h >> np.uint64(_PLACE)) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while n < width:
        step = min(n, width - n)
        least = np.minimum(least[: len(least) - step], least[step:])
        n += step
    at = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]].astype(np.int64), first, last, at[first] - first


def _anchor_rows(length: int, least: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []
            for row, text in zip(b["_row"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                body = text.as_py()
                anchors, first, last, lead = contexts_of(np.frombuffer(body, np.uint8), least, gram)
                if len(anchors):
                    digest = [
                        int.from_bytes(hashlib.blake2b(body[i : j + length], digest_size=8).digest(), "little", signed=True)
                        for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                    parts.append((np.full(len(anchors), row), anchors, np.array(digest, np.int64), first, last, lead))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.array([], np.int64)] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(k)) for c, k in zip(columns, ("i8", "i8", "i8", "i4", "i4", "i4"), strict=True)],
                ["_row", "anchor", "context", "first", "last", "lead"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        i = b.schema.get_field_index("text")
        yield b.set_column(i, pa.field("text", pa.binary()), pa.array([pack(t.as_buffer()) for t in b["text"].cast(pa.binary())], pa.binary()))


def _context_rows(length: int):
    """The bytes of the contexts that a text stands for; for crowded anchors also what precedes them, reversed, and what follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, text, own in zip(b["_row"].to_pylist(), b["text"].to_pylist(), b["own"].to_pylist(), strict=True):
                body = zstandard.decompress(text)
                for o in own:
                    at = o["first"] + o["lead"]
                    rows.append((
                        o["anchor"], o["crowded"], o["n"], row, o["first"], o["last"], o["lead"],
                        zstandard.compress(body[o["first"] : o["last"] + length], 3),
                        body[o["first"] : at][::-1] if o["crowded"] else None, body[at : at + length] if o["crowded"] else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["anchor", "crowded", "n", "_row", "first", "last", "lead", "bytes", "left", "right"])

    return run


_BODY = ("anchor", "n", "_row", "first", "last", "lead", "bytes")


def _bodies(batch: pa.RecordBatch, more: tuple[str, ...] = ()) -> Iterator[tuple]:
    return zip(*[batch[c].to_pylist() for c in _BODY + more], strict=True)


def previous_factors(place: list[int], lcp: list[int]) -> list[int]:
    """Longest previous factor of each suffix, in suffix order: its longest prefix that also starts at a smaller place.

    ``lcp`` holds the common prefix of each suffix with the one before it. The stack holds suffixes with growing places, each with
    its common prefix with the one below, which is its previous smaller place; whatever takes it off is its next smaller one.
    """
    out = [0] * len(place)
    stack: list[tuple[int, int]] = []
    for k in range(len(place) + 1):
        here, common = (place[k], lcp[k]) if k < len(place) else (-1, 0)
        while stack and place[stack[-1][0]] > here:
            j, below = stack.pop()
            out[j] = max(below, common)
            common = min(below, common)
        stack.append((k, common if stack else 0))
    return out


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``values`` from each ``first`` to its ``last``, both included."""
    span = last - first + 1
    level = np.log2(span).astype(np.int64) if len(span) else span
    out = np.empty(len(first), dtype=values.dtype)
    table = values
    for n in range(int(level.max(initial=0)) + 1):
        if n:
            half = 1 << (n - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == n)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << n) + 1])
    return out


def suffix_orders(group: list[tuple], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each distance before the anchor: the contexts in the order of their suffixes from there, and the common prefixes.

    Contexts of several anchors may come at once; suffixes of different anchors count as sharing nothing. Contexts drop out once no
    suffix of theirs can share ``least`` bytes with another one.
    """
    texts = [zstandard.decompress(g[6]) for g in group]
    lead = np.array([g[5] for g in group])
    anchor = np.unique(np.array([g[0] for g in group]), return_inverse=True)[1]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    at = np.cumsum(sizes) - sizes + lead  # of the anchor's first byte
    rights = [t[g[5] :] for t, g in zip(texts, group, strict=True)]
    order = np.array(sorted(range(len(group)), key=lambda i: (anchor[i], rights[i])), dtype=np.int64)
    length = (sizes - lead)[order]
    lcp = np.zeros(len(order), dtype=np.int64)
    open_ = 1 + np.flatnonzero(anchor[order[1:]] == anchor[order[:-1]])
    reach, n = np.minimum(length[1:], length[:-1]), 0
    while len(open_):
        open_ = open_[n < reach[open_ - 1]]
        same = flat[at[order[open_]] + n] == flat[at[order[open_ - 1]] + n]
        open_, n = open_[same], n + 1
        lcp[open_] = n
    distance = 0
    while len(order):
        yield distance, order, lcp
        distance += 1
        longest = np.maximum(lcp, np.append(lcp[1:], 0))
        left = lead[order] - distance
        stay = np.flatnonzero((left >= 0) & (longest + 1 + left >= least))
        if not len(stay):
            return
        who = order[stay]
        key = anchor[who] * 256 + flat[at[who] - distance]
        turn = np.argsort(key, kind="stable")
        who, key, old = who[turn], key[turn], stay[turn]
        lower = 1 + np.flatnonzero(key[1:] == key[:-1])
        grown = np.zeros(len(who), dtype=np.int64)
        grown[lower] = 1 + _range_minima(lcp, old[lower - 1] + 1, old[lower])
        order, lcp = who, grown


def _factors(order: np.ndarray, lcp: np.ndarray, place: np.ndarray, least: int, keep_first: bool) -> np.ndarray:
    """Length of each suffix's longest match at a smaller place, or at any other one; 0 where it is below ``least``."""
    if not keep_first:
        longest = np.maximum(lcp, np.append(lcp[1:], 0))
        return np.where(longest >= least, longest, 0)
    out = np.zeros(len(order), dtype=np.int64)
    tied = np.append(lcp >= least, False)
    members = np.flatnonzero(tied[:-1] | tied[1:])
    if len(members):
        common = np.where(lcp[members] >= least, lcp[members], 0)
        out[members] = previous_factors(place[order[members]].tolist(), common.tolist())
    return out


def _runs(rows: np.ndarray, starts: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
    """Starts as intervals of consecutive ones that are long, or that are not."""
    by = np.lexsort((starts, rows))
    rows, starts, long = rows[by], starts[by], long[by]
    new = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(starts) != 1) | (long[1:] != long[:-1]))[: len(rows)])
    end = np.append(new[1:], len(rows))[: len(new)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[new].astype(np.int64)), pa.array(starts[new].astype(np.int32)), pa.array(starts[end].astype(np.int32)), pa.array(long[new])],
        ["_row", "first", "last", "long"])


def _longest(group: list[tuple], least: int, keep_first: bool, anywhere: bool) -> tuple[np.ndarray, ...]:
    """Row and start of all strings, context by context, with their longest match at a smaller place and their longest one anywhere.

    Either is 0 where it is below ``least``, and where it is not asked for.
    """
    row, first, last, lead = (np.array([g[i] for g in group]) for i in (2, 3, 4, 5))
    place = np.empty(len(group), dtype=np.int64)
    place[np.lexsort((first + lead, row))] = np.arange(len(group))
    size = last - first + 1
    at = np.cumsum(size) - size
    found = np.zeros((2, size.sum()), dtype=np.int64)
    for distance, order, lcp in suffix_orders(group, least):
        start = lead[order] - distance
        own = np.flatnonzero(start < size[order])
        to = at[order[own]] + start[own]
        for k, wanted in enumerate((keep_first, anywhere)):
            if wanted:
                found[k, to] = _factors(order, lcp, place, least, k == 0)[own]
    return np.repeat(row, size), np.arange(size.sum()) - np.repeat(at - first, size), found[0], found[1]


def _repeats(group: list[tuple], length: int, least: int, keep_first: bool) -> pa.RecordBatch:
    """Starts of the strings of whole anchors that occur before (or, unless the first is to stay, anywhere else)."""
    rows, starts, earlier, anywhere = _longest(group, least, keep_first, not keep_first)
    hit = np.flatnonzero(earlier if keep_first else anywhere * _once(group))
    return _runs(rows[hit], starts[hit], (earlier if keep_first else anywhere)[hit] >= length)


def _once(group: list[tuple]) -> np.ndarray:
    """Whether each string's context occurs once; strings of one that occurs again are known already."""
    return np.repeat(np.array([g[1] == 1 for g in group]), [g[4] - g[3] + 1 for g in group])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much of one side each context shares with its neighbours, sorted by anchor and side; a task's ends keep their side, as they have more."""
    held, before = None, None  # the last context, whose next one is still to come, and what it shares with the one before
    for b in batches:
        rows = []
        for own in zip(*[b[c].to_pylist() for c in ("anchor", "_row", "first", "side")], strict=True):
            if held is not None:
                shared = _common(held[3], own[3]) if held[0] == own[0] else 0
                rows.append((*held[:3], shared, held[3]) if before is None else (*held[:3], max(before, shared), None))
                before = shared
            held = own
        yield _near_batch(rows)
    if held is not None:
        yield _near_batch([(*held[:3], before or 0, held[3])])


def _near_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "_row", "first", "reach", "side"])


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of tasks with what they share with the ends of the tasks beside theirs."""
    for b in batches:
        sides = zip(*[b[c].to_pylist() for c in ("reach", "side", "before", "after")], strict=True)
        reach = [max(n, *(0 if x is None else _common(own, x) for x in near)) for n, own, *near in sides]
        yield pa.RecordBatch.from_arrays([b["_row"], b["first"], pa.array(reach, pa.int32())], ["_row", "first", "reach"])


def _reach(crowd: DataFrame, side: str) -> DataFrame:
    """The most that each context shares with any other one of its anchor, on one side of it."""
    near = written(
        crowd.select("anchor", "_row", "first", F.col(side).alias("side")).repartitionByRange("anchor", "side", "_row")
        .sortWithinPartitions("anchor", "side", "_row")
        .mapInArrow(_near_rows, "anchor long, _row long, first int, reach int, side binary"), side)
    order = Window.partitionBy("anchor").orderBy("side", "_row")
    ends = near.where("side is not null").select(
        "_row", "first", "reach", "side", F.lag("side").over(order).alias("before"), F.lead("side").over(order).alias("after"))
    return near.where("side is null").select("_row", "first", "reach").unionByName(
        ends.mapInArrow(_end_rows, "_row long, first int, reach int"))


def shared_outside(group: list[tuple[int, bytes]], most: int) -> np.ndarray:
    """How much of what follows its anchor each context of a piece can share with those of other pieces, given anchors and these bytes in order."""
    near = [_common(x[1], y[1]) if x[0] == y[0] else 0 for x, y in zip(group[:-1], group[1:], strict=True)]
    return np.maximum(np.minimum.accumulate([most, *near]), np.minimum.accumulate([most, *near[::-1]])[::-1])


def _piece(group: list[tuple], length: int, least: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """As ``_repeats`` for a piece of crowded anchors; then, by key, each string that may occur in other pieces, at its first place here."""
    rows, starts, earlier, anywhere = _longest(group, least, True, not keep_first)
    once = _once(group)
    factor = earlier if keep_first else anywhere * once
    hit = np.flatnonzero(factor)
    runs = _runs(rows[hit], starts[hit], factor[hit] >= length)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(runs.num_rows, pa.int64()), runs["_row"], runs["first"], runs["last"], pa.array(np.zeros(runs.num_rows, bool)), runs["long"]], _PIECE)
    outside = shared_outside([(g[0], g[7]) for g in group], length)
    parts: list[tuple] = []
    at = 0
    for g, most in zip(group, outside.tolist(), strict=True):
        here = np.arange(at, at + g[4] - g[3] + 1)
        distance = g[5] - np.arange(len(here))
        at += len(here)
        for size, seed in ((least, 5), (length, 3)) if least < length else ((length, 3),):
            named = np.flatnonzero((size - distance <= min(most, g[9])) & (distance <= g[8]) & (earlier[here] < size))
            if not len(named):
                continue
            h = gram_hashes(np.frombuffer(zstandard.decompress(g[6]), np.uint8), size, seed=seed)
            named = named[named < len(h)]
            key = _mix(h[named] + np.uint64(g[0] & 0xFFFF_FFFF_FFFF_FFFF)).astype(np.int64)
            which = here[named]
            parts.append((key, rows[which], starts[which], once[which] & (anywhere[which] < size), np.full(len(named), size == length)))
    if parts:
        key, row, start, alone, long = (np.concatenate(c) for c in zip(*parts, strict=True))
        start = pa.array(start.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), start, start, pa.array(alone), pa.array(long)], _PIECE)


_PIECE = ["key", "_row", "first", "last", "alone", "long"]


def _ordered(length: int, least: int, keep_first: bool):
    """Contexts arrive sorted by anchor; whole anchors are gathered to batches of about ``BATCH`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, current = 0, None
        for b in batches:
            for body in _bodies(b):
                if body[0] != current and size > BATCH:
                    yield _repeats(held, length, least, keep_first)
                    held, size = [], 0
                current = body[0]
                held.append(body)
                size += 2 * length
        if held:
            yield _repeats(held, length, least, keep_first)

    return run


def _pieces(length: int, least: int, keep_first: bool):
    """Contexts arrive sorted by anchor and by what follows it; every ``BATCH`` bytes of them are a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for body in _bodies(b, ("right", "before", "after")):
                held.append(body)
                if 2 * length * len(held) > BATCH:
                    yield from _piece(held, length, least, keep_first)
                    held = []
        if held:
            yield from _piece(held, length, least, keep_first)

    return run


def _merged(starts: list[tuple[int, int]]) -> list[list[int]]:
    """Spans of bytes, given first start and end, joined where they touch."""
    spans: list[list[int]] = []
    for a, z in sorted(starts):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z)
        else:
            spans.append([a, z])
    return spans


def _cut(text: bytes | None, runs: list | None, length: int, least: int) -> tuple[bytes, list, list, int]:
    """What is left of a text, the spans removed, the repeated passages, and its length."""
    body = b"" if text is None else zstandard.decompress(text)
    runs = [(r["first"], r["last"], min(r["last"], len(body) - length) if r["long"] else -1) for r in runs or ()]
    spans = _merged([(a, z + length) for a, _, z in runs if z >= a])
    kept, at = [], 0
    for a, z in spans:
        kept.append(body[at:a])
        at = z
    kept.append(body[at:])
    covered = _merged([(a, max(z + least, long + length)) for a, z, long in runs])
    passages = [(a, z) for a, z in covered if len(body[a:z].split()) > WORDS]
    return b"".join(kept), spans, passages, len(body)


def _cut_rows(length: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                done = [_cut(t, r, length, least) for t, r in zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True)]
                spans, passages = ([[{"start": a, "end": z} for a, z in d[k]] for d in done] for k in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [b["id"], pa.array([d[3] for d in done], pa.int64()), pa.array([d[0] for d in done], pa.binary()),
                     pa.array(spans, kind), pa.array(passages, kind)],
                    ["id", "n_bytes", "kept", "spans", "passages"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = True,
    least: int = LEAST,
) -> DataFrame:
    """One row per document: its id, n_bytes, kept (the bytes that remain), spans (removed start and end, in bytes), passages.

    A byte goes if a string of ``length`` bytes over it also starts at an earlier place (a smaller row of ``docs``, or further
    left in the same text); with ``keep_first=False``, at any other place. Matches lie within one text; overlapping ones count;
    all are judged on the input. A null text counts as empty. Texts shorter than ``length`` lose nothing. Repeated rows are
    copies of each other; ids may repeat or be null. An empty table gives an empty result. ``passages`` are stretches of more than
    ``WORDS`` words that strings of ``least`` bytes cover which occur likewise; they are reported, not removed. ``least`` is at most
    ``length`` and at least ``gram``.
    """
    least = min(least, length)
    held = numbered(docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), "texts")
    anchors = written(
        held.select("_row", "text").mapInArrow(
            _anchor_rows(length, least, gram), "_row long, anchor long, context long, first int, last int, lead int"), "anchors")
    contexts = written(
        anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("_row", "first", "last", "lead")).alias("at")), "contexts")

    # Contexts that occur again, as wholes.
    again = contexts.where("n > 1").select("anchor", "context", F.col("at._row").alias("at"), F.col("at.first").alias("at_first"))
    equal = anchors.join(again, ["anchor", "context"])
    if keep_first:
        equal = equal.where("not (_row = at and first = at_first)")
    # Starts from which a text holds fewer than ``length`` bytes are set apart where the text is at hand.
    equal = equal.select("_row", "first", "last", F.lit(True).alias("long"))

    # Anchors with differing contexts: one copy of each is compared.
    several = written(
        contexts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
        .select("anchor", (F.col("kinds") > CROWDED).alias("crowded")), "several")
    owners = contexts.join(several, "anchor").groupBy(F.col("at._row").alias("_row")).agg(F.collect_list(F.struct(
        "anchor", "crowded", "n", *[F.col(f"at.{c}").alias(c) for c in ("first", "last", "lead")])).alias("own"))
    packed = held.mapInArrow(_packed, T.StructType([
        T.StructField("id", held.schema["id"].dataType), T.StructField("text", T.BinaryType()),
        T.StructField("_row", T.LongType(), False)]))
    bodies = written(
        packed.join(owners.hint("merge"), "_row").mapInArrow(
            _context_rows(length),
            "anchor long, crowded boolean, n long, _row long, first int, last int, lead int, bytes binary, left binary, right binary"), "bodies")
    span = "_row long, first int, last int, long boolean"
    apart = bodies.where("not crowded").drop("left", "right").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        _ordered(length, least, keep_first), span)

    # Crowded anchors: pieces are put in order; the strings that several pieces may hold are counted, one of each from a piece.
    crowd = bodies.where("crowded")
    before, after = (_reach(crowd, side).withColumnRenamed("reach", name) for side, name in (("left", "before"), ("right", "after")))
    pieces = written(
        crowd.drop("left").join(before, ["_row", "first"]).join(after, ["_row", "first"]).repartitionByRange("anchor", "right", "_row")
        .sortWithinPartitions("anchor", "right", "_row").mapInArrow(
            _pieces(length, least, keep_first), "key long, _row long, first int, last int, alone boolean, long boolean"), "pieces")
    within = pieces.where("key is null").select("_row", "first", "last", "long")
    strings = pieces.where("key is not null")
    common = written(
        strings.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("_row", "first")).alias("at")).where("n > 1")
        .select("key", F.col("at._row").alias("at"), F.col("at.first").alias("at_first")), "common")
    across = strings if keep_first else strings.where("alone")  # the others are known from their piece
    across = across.join(common, "key")
    if keep_first:
        across = across.where("not (_row = at and first = at_first)")
    across = across.select("_row", "first", "last", "long")

    runs = equal.unionByName(apart).unionByName(within).unionByName(across).groupBy("_row").agg(F.collect_list(F.struct("first", "last", "long")).alias("runs"))
    kind = held.schema["id"].dataType.simpleString()
    pairs = "array<struct<start:int,end:int>>"
    return packed.join(runs.hint("merge"), "_row", "left").select("id", "text", "runs").mapInArrow(
        _cut_rows(length, least), f"id {kind}, n_bytes long, kept binary, spans {pairs}, passages {pairs}"
    ).withColumnRenamed("id", id_col)
