"""Line dedup: passages of lines that the corpus holds more than once stay at their first place only.

All pairs of adjacent lines, and single lines of many words, are counted over all documents as runs. A later copy of a run names
the place of the first; runs of one text that follow each other there as here are grown into one stretch, which goes after its
bytes have been compared with those at the first place. So a repeated passage goes line by line, whatever stands around it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import numbered, shielded, unshielded, written

#: A single line is a run of its own if it has more words than this.
LONG = 50
#: Rows that leave a task at a time.
SLICE = 500


def runs_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """First and end line of each run, in order: adjacent lines, long single lines, and blank stretches with the lines around.

    Runs overlap. Pairs of blank lines are none.
    """
    out, last = [], -1
    for i, line in enumerate(lines):
        if not line.strip():
            if i and last == i - 1:
                out.append((i - 1, i + 1))
            continue
        if i:
            out.append((i - 1, i + 1))
        if last >= 0 and i - last > 3:
            out.append((last, i + 1))
        if len(line) > 2 * LONG and len(line.split()) > LONG:
            out.append((i, i + 1))
        last = i
    return out


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            rows, owns, firsts, ends, digests = [], [], [], [], []
            for row, own, text in zip(b["_row"].to_pylist(), b["id"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                lines = text.as_py().split(b"\n")
                places = runs_of(lines)
                rows += [row] * len(places)
                owns += [own] * len(places)
                for x, y in places:
                    firsts.append(x)
                    ends.append(y)
                    digests.append(hashlib.blake2b(b"\n".join(lines[x:y]), digest_size=12).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(owns, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32()),
                 pa.array(digests, pa.binary())], ["_row", "id", "x", "y", "run"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of runs that follow each other in both texts, as one stretch of lines."""
    for b in batches:
        out: list[tuple[int, int, int, int, int]] = []
        for row, copies in zip(b["_row"].to_pylist(), b["copies"], strict=True):
            flat = copies.values.flatten()
            x, y, at, at_x = (f.to_numpy().astype(np.int64) for f in flat)
            order = np.lexsort((x, at_x - x, at))
            now = None
            for x1, y1, at1, from1 in zip(*(f[order].tolist() for f in (x, y, at, at_x)), strict=True):
                if now and now[0] == at1 and now[1] == from1 - x1 and x1 <= now[3]:
                    now[3] = max(now[3], y1)
                    continue
                if now:
                    out.append((row, now[2], now[3] - now[2], now[0], now[1] + now[2]))
                now = [at1, from1 - x1, x1, y1]
            if now:
                out.append((row, now[2], now[3] - now[2], now[0], now[1] + now[2]))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)],
            ["_row", "x", "n", "at", "at_x"])


def _packed(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            small = [None if t is None else pack(t.encode()) for t in b[text_col].to_pylist()]
            yield b.set_column(b.schema.get_field_index(text_col), pa.field(text_col, pa.binary()), pa.array(small, pa.binary()))

    return run


def _bodies(text_col: str):
    """The bytes of the stretches of which a text holds the first copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for row, text, own in zip(b["_row"].to_pylist(), b[text_col].to_pylist(), b["own"].to_pylist(), strict=True):
                lines = zstandard.decompress(text).split(b"\n")
                for one in own:
                    x, n = one["at_x"], one["n"]
                    out.append((row, x, n, zstandard.compress(b"\n".join(lines[x : x + n]), 3)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                ["at", "at_x", "n", "body"])

    return run


def _stripped(text: bytes, later: list | None) -> tuple[str, int, list[int]]:
    """A text without the stretches of ``later`` whose bytes agree, its number of lines, and the lines removed."""
    lines = zstandard.decompress(text).split(b"\n")
    drop: set[int] = set()
    for one in later or ():
        x, first = one["x"], zstandard.decompress(one["body"]).split(b"\n")
        if lines[x : x + len(first)] == first:
            drop.update(range(x, x + len(first)))
            continue
        for i, j in runs_of(first):
            if lines[x + i : x + j] == first[i:j]:
                drop.update(range(x + i, x + j))
    return b"\n".join(line for i, line in enumerate(lines) if i not in drop).decode(), len(lines), sorted(drop)


def _strip(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                done = [
                    (None, 0, []) if text is None else _stripped(text, later)
                    for text, later in zip(b[text_col].to_pylist(), b["later"].to_pylist(), strict=True)
                ]
                b = b.set_column(
                    b.schema.get_field_index(text_col), pa.field(text_col, pa.string()), pa.array([d[0] for d in done], pa.string()))
                b = b.append_column("_lines", pa.array([d[1] for d in done], pa.int64()))
                b = b.append_column("_removed", pa.array([d[2] for d in done], pa.list_(pa.int32())))
                yield b.drop_columns(["later"])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, ``text_col`` without later copies of runs, with n_lines and removed (line numbers from 0).

    Lines are split at ``\\n``. A run is two adjacent lines that are not both blank, or one line of over ``LONG`` words. The first
    copy is the one with the smallest id, then the earliest row, then the first line; null ids come last. Every line of a later
    copy goes, so a repeated passage of any length goes whole; each line stays at its first place. Copies inside one text
    count, also those that overlap. A null text stays null and has no lines; an empty one has one. A text of which
    everything goes becomes empty. Repeated rows are copies of each other. All other columns stay, but for those that have the
    names of the results. An empty table gives an empty result.
    """
    inner, names = shielded(docs)
    held = numbered(inner, "lines")
    text_col, id_col = names[text_col], names[id_col]
    own = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    able = F.col(text_col).contains("\n") | (F.length(text_col) > 2 * LONG)
    keyed = held.where(able).select("_row", own.alias("id"), F.col(text_col).alias("text"))
    runs = written(keyed.mapInArrow(_run_rows, "_row long, id long, x int, y int, run binary"), "runs")
    firsts = written(
        runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("id", "_row", "x")).alias("first")).where("n > 1")
        .select("run", F.col("first._row").alias("at"), F.col("first.x").alias("at_x")), "firsts")
    later = runs.join(firsts, "run").where("not (_row = at and x = at_x)")
    stretches = written(
        later.groupBy("_row").agg(F.collect_list(F.struct("x", "y", "at", "at_x")).alias("copies"))
        .mapInArrow(_stretches, "_row long, x int, n int, at long, at_x int"), "stretches")

    # One exchange of the texts serves both joins: the key cannot be null, and both read all columns.
    fields = [
        T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType, f.name != "_row") for f in held.schema.fields]
    packed = held.mapInArrow(_packed(text_col), T.StructType(fields))
    owners = stretches.select("at", "at_x", "n").distinct().groupBy(F.col("at").alias("_row")).agg(
        F.collect_list(F.struct("at_x", "n")).alias("own"))
    bodies = packed.join(owners.hint("merge"), "_row").mapInArrow(_bodies(text_col), "at long, at_x int, n int, body binary")
    copies = stretches.join(bodies, ["at", "at_x", "n"]).groupBy("_row").agg(F.collect_list(F.struct("x", "body")).alias("later"))
    joined = packed.join(copies.hint("merge"), "_row", "left")
    out = [T.StructField(c, held.schema[c].dataType) for c in joined.columns if c != "later"]
    done = joined.mapInArrow(
        _strip(text_col),
        T.StructType([*out, T.StructField("_lines", T.LongType()), T.StructField("_removed", T.ArrayType(T.IntegerType()))]))
    return unshielded(done, names, {"n_lines": F.col("_lines"), "removed": F.col("_removed")})
