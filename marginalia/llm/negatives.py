"""Hard negatives by segment summaries.

A vector is cut into segments, and of each its mean and its deviation (the length of what the mean leaves over) are stored. For two
vectors, the product of the means gives the part of their score that the means explain, and by Cauchy and Schwarz the rest lies within
plus or minus the product of the deviations. Added up over segments, this bounds the score on both sides. The bounds are taken
with few long segments first and with more, shorter ones for the pairs that are still open; only what is left is scored exactly.

Anchors and candidates meet as blocks. Each task keeps the best found so far, which raises the bar for its later blocks; the
bests of all tasks are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import numbered, parallelism, written
from marginalia.llm.topk import quantised

#: Numbers of segments, from coarse to fine. The finest is stored, the others follow from it.
LEVELS = (1, 4, 16)
#: Rows of a block of candidates, questions of a block, and questions that are worked on at a time.
CANDIDATES, QUESTIONS, SLICE = 4096, 4096, 64
#: Blocks of questions whose bests a task holds at a time.
HELD = 8
SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score, in hundredths of the positive's.
LEAST, MOST = 80, 100
_FAR = 1 << 62


def _borders(dim: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * dim // parts


def summaries(cells: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (times the root of the length) and deviation of each of ``parts`` segments of each row."""
    at = _borders(cells.shape[1], parts)
    means, rests = np.zeros((len(cells), parts)), np.zeros((len(cells), parts))
    for p in range(parts):
        part = cells[:, at[p] : at[p + 1]].astype(np.float64)
        if part.shape[1]:
            mean = part.mean(axis=1)
            means[:, p] = mean * np.sqrt(part.shape[1])
            rests[:, p] = np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))
    return means, rests


def coarser(means: np.ndarray, rests: np.ndarray, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of ``parts`` longer segments, each made of whole segments of the given ones."""
    fine = np.sqrt(np.diff(_borders(dim, means.shape[1])))
    step = means.shape[1] // parts
    m, r = np.zeros((len(means), parts)), np.zeros((len(means), parts))
    for p in range(parts):
        own = slice(p * step, (p + 1) * step)
        length = np.sqrt(max((fine[own] ** 2).sum(), 1))
        mean = (means[:, own] * fine[own]).sum(axis=1) / length**2
        m[:, p] = mean * length
        r[:, p] = np.sqrt((rests[:, own] ** 2 + (means[:, own] - mean[:, None] * fine[own]) ** 2).sum(axis=1))
    return m, r


class _Bests:
    """Of each question of a block, the ``k`` best found so far, best first."""

    def __init__(self, asks: np.ndarray, k: int):
        self.asks, self.k = asks, k
        self.scores, self.ids, self.rows = ([np.zeros(0, np.int64)] * len(asks) for _ in range(3))

    def bar(self, i: int, low: int) -> int:
        """A score below this one is of no use: not asked for, or below k better ones."""
        return max(low, int(self.scores[i][-1])) if len(self.scores[i]) == self.k else low

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores, ids, rows = (np.concatenate(x) for x in ((self.scores[i], scores), (self.ids[i], ids), (self.rows[i], rows)))
        first = np.lexsort((rows, ids, -scores))[: self.k]
        self.scores[i], self.ids[i], self.rows[i] = scores[first], ids[first], rows[first]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({
            "ask": np.repeat(self.asks, [len(s) for s in self.scores]), "vec_id": np.concatenate([*self.ids, np.zeros(0, np.int64)]),
            "row": np.concatenate([*self.rows, np.zeros(0, np.int64)]), "score": np.concatenate([*self.scores, np.zeros(0, np.int64)])})


def _matrix(cells, dim: int) -> np.ndarray:
    out = np.zeros((len(cells), dim), dtype=np.int64)
    for i, v in enumerate(cells):
        out[i, : len(v)] = v
    return out


def _numbers(data: bytes, kind: type = np.int64, width: int = 0) -> np.ndarray:
    flat = np.frombuffer(data, kind)
    return flat.reshape(-1, width) if width else flat


def best_within(candidates: DataFrame, questions: DataFrame, same: bool, k: int, dim: int, exact_float: bool, slots: int) -> DataFrame:
    """Of each question the ``k`` best candidates (ask, vec_id, row, score) with a score from ``low`` to ``high``.

    ``questions`` has ask, row (of the anchor), label, cells, low, high and block. Candidates are of the same label, without the anchor
    itself, or of another label. Ties go to the smaller vec_id.
    """
    levels = [p for p in LEVELS if p <= dim] or [1]

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        # Questions of one label lie together, so that a slice of them asks for few columns of a block.
        b = b.sort_values(["label", "row", "ask"])
        columns = {c: [b[c].to_numpy("int64").tobytes()] for c in ("ask", "row", "label", "low", "high")}
        return pd.DataFrame({"block": [int(b["block"].iloc[0])], **columns, "cells": [_matrix(b["cells"], dim).tobytes()]})

    blocks = questions.groupBy("block").applyInPandas(
        gather, "block int, ask binary, row binary, label binary, low binary, high binary, cells binary")
    copies = blocks.toDF("block", "ask", "q_row", "q_label", "low", "high", "q_cells").withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    n_blocks = F.explode(F.sequence(F.lit(0), F.lit(questions.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0])))
    # Sizes of binary columns are guessed too low by far, so the kind of join is named.
    pairs = candidates.withColumn("block", n_blocks).join(copies.hint("merge"), ["block", "slot"])

    def meet(r, bests: _Bests) -> None:
        ids, rows, labels = _numbers(r.ids), _numbers(r.rows), _numbers(r.labels)
        kind = np.float64 if exact_float else np.int64
        right = _numbers(r.cells, np.int64, dim).astype(kind)
        fine = _numbers(r.means, np.float64, levels[-1]), _numbers(r.rests, np.float64, levels[-1])
        stored = [fine if p == levels[-1] else coarser(*fine, dim, p) for p in levels]
        q_rows, q_labels, low, high = _numbers(r.q_row), _numbers(r.q_label), _numbers(r.low), _numbers(r.high)
        q_cells = _numbers(r.q_cells, np.int64, dim)
        longest = np.sqrt((right.astype(np.float64) ** 2).sum(axis=1)).max()
        for start in range(0, len(q_rows), SLICE):
            s = slice(start, start + SLICE)
            bar = np.array([bests.bar(i, int(low[i])) for i in range(start, start + len(q_rows[s]))], dtype=np.float64)
            top = high[s].astype(np.float64)
            alike = q_labels[s][:, None] == labels[None, :]
            live = alike & (q_rows[s][:, None] != rows[None, :]) if same else ~alike
            # Questions of one anchor share its products.
            _, first, of = np.unique(q_rows[s], return_index=True, return_inverse=True)
            left = q_cells[s][first].astype(kind)
            room = 1e-12 * longest * np.sqrt((left.astype(np.float64) ** 2).sum(axis=1)).max(initial=0) + 1e-6  # for rounding
            for p, (means, rests) in zip(levels, stored, strict=True):
                at = np.flatnonzero(live.any(axis=0))
                if not len(at):
                    break
                m, d = summaries(left, p)
                middle, around = (m @ means[at].T)[of], (d @ rests[at].T)[of] + room
                open_ = live[:, at]
                if same and len(at) >= k:
                    # At least k candidates reach the k-th largest lower bound.
                    sure = np.where(open_, middle - around, -np.inf)
                    bar = np.maximum(bar, np.partition(sure, len(at) - k, axis=1)[:, len(at) - k])
                live[:, at] = open_ & (middle + around >= bar[:, None]) & (middle - around <= top[:, None])
            at = np.flatnonzero(live.any(axis=0))
            if not len(at):
                continue
            scores = (left @ right[at].T).astype(np.int64)[of]
            fits = live[:, at] & (scores >= bar[:, None]) & (scores <= high[s][:, None])
            for i in np.flatnonzero(fits.any(axis=1)):
                hit = np.flatnonzero(fits[i])
                if len(hit) > 4 * k:
                    # Of very many, those from the k-th best on.
                    hit = hit[scores[i, hit] >= np.partition(scores[i, hit], len(hit) - k)[len(hit) - k]]
                bests.add(start + i, scores[i, hit], ids[at[hit]], rows[at[hit]])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Bests] = {}
        for batch in batches:
            for r in batch.itertuples():
                if r.block not in held:
                    if len(held) == HELD:
                        yield held.pop(next(iter(held))).frame()
                    held[r.block] = _Bests(_numbers(r.ask), k)
                meet(r, held[r.block])
        for bests in held.values():
            yield bests.frame()

    found = pairs.mapInPandas(work, "ask long, vec_id long, row long, score long")
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
    least: int = LEAST, most: int = MOST, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product of quantised vectors with the anchor; a shorter vector counts as padded with zeros. An anchor's positives are
    the ``positives`` best other rows of its label; of each, the ``negatives`` best rows of another label follow whose score is from ``least`` to
    ``most`` hundredths of the positive's. Fewer are returned where there are fewer; a positive of a score below zero has none. Ties go to the
    smaller id, then to the row read first. Rows with a null id, label or vector, or with an unsound component take no part. Repeated rows are
    rows of their own: a copy of an anchor may be its positive. An empty table gives no rows. Scores must stay within 62 bits.
    """
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    chosen = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        quantised(F.col(f"`{vector_col}`"), scale).alias("cells"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("cells").isNotNull())
    rows = numbered(chosen, "vectors", "row")
    size = F.coalesce(F.max(F.size("cells")), F.lit(0))
    top = F.coalesce(F.max(F.array_max(F.transform("cells", F.abs))), F.lit(0))
    n, n_anchors, dim, peak = rows.agg(F.count("*"), F.count_if("asks"), size, top).first()
    dim = max(1, int(dim))
    exact_float = dim * int(peak) ** 2 < 1 << 53
    finest = max([p for p in LEVELS if p <= dim] or [1])

    def dealt(n_questions: int) -> tuple[int, int]:
        blocks = max(1, ceil(n_questions / QUESTIONS))
        return blocks, max(1, min(ceil(n / CANDIDATES), ceil(4 * parallelism(spark) / blocks)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), CANDIDATES):
                part = b.iloc[i : i + CANDIDATES]
                cells = _matrix(part["cells"], dim)
                means, rests = summaries(cells, finest)
                yield pd.DataFrame({
                    "first": [int(part["row"].iloc[0])], "rows": [part["row"].to_numpy("int64").tobytes()],
                    "ids": [part["vec_id"].to_numpy("int64").tobytes()], "labels": [part["label"].to_numpy("int64").tobytes()],
                    "cells": [cells.tobytes()], "means": [means.tobytes()], "rests": [rests.tobytes()]})

    packed = written(
        rows.select("row", "vec_id", "label", "cells").mapInPandas(
            pack, "first long, rows binary, ids binary, labels binary, cells binary, means binary, rests binary"), "segments")

    def candidates(slots: int) -> DataFrame:
        return packed.withColumn("slot", F.pmod(F.xxhash64("first"), F.lit(slots)).cast("int")).drop("first")

    def block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")

    anchors = rows.where("asks").select("row", "vec_id", "label", "cells")
    blocks, slots = dealt(n_anchors)
    asking = anchors.select(
        F.col("row").alias("ask"), "row", "label", "cells", F.lit(-_FAR).alias("low"), F.lit(_FAR).alias("high"), block(blocks))
    near = best_within(candidates(slots), asking, True, positives, dim, exact_float, slots).select(
        F.col("ask").alias("row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = numbered(near.join(anchors.withColumnRenamed("vec_id", "anchor_id"), "row"), "positives", "ask")

    blocks, slots = dealt(n_anchors * positives)
    low = F.call_function("div", F.col("positive_score") * least + 99, F.lit(100))
    high = F.call_function("div", F.col("positive_score") * most, F.lit(100))
    # Below zero the range is empty, since ``least`` of the score lies above ``most`` of it.
    fair = pairs.where(F.col("positive_score") >= 0)
    asking = fair.select("ask", "row", "label", "cells", low.alias("low"), high.alias("high"), block(blocks))
    hard = best_within(candidates(slots), asking, False, negatives, dim, exact_float, slots)
    facts = fair.select("ask", "anchor_id", "positive_id", "positive_score")
    return hard.join(facts, "ask").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
