"""Exact top k by histograms: the k-th score of each query is located bin by bin, then rows at or above it are kept.

Vectors are written as blocks of rows. Queries and candidates meet block by block; each pair of blocks is scored by one
matrix product per pass, and only counts leave it. A pass cuts the interval that holds a query's k-th score into
``BINS`` bins; counts are summed over all candidates, and the bin that holds it is the next interval, until it is one
score wide. A last pass keeps what reaches the k-th score, and ties go to the smaller id.
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

BINS = 1024
#: Rows of a block, and of the queries that are scored at a time.
CANDIDATES, QUERIES, SLICE = 8192, 4096, 256


def quantised(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of each component, null for a vector that is null or holds a null or non-finite one."""
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, cells)


def _matrix(cells, dim: int) -> np.ndarray:
    out = np.zeros((len(cells), dim), dtype=np.int64)
    for i, v in enumerate(cells):
        out[i, : len(v)] = v
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """For each row that ``is_query`` selects, its ``k`` best other rows: query_id, rank, vec_id, score.

    The score is the inner product of the quantised vectors; a shorter vector counts as padded with zeros. Ties go to the
    smaller id. All rows are returned where there are fewer than ``k``. Rows with a null id or an unsound vector take no
    part. Repeated rows are rows of their own; only the query's own row is left out. Components must stay within 31 bits
    after scaling.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector_col}`"), scale).alias("cells"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & F.col("cells").isNotNull())
    rows = numbered(chosen, "vectors")
    size = F.coalesce(F.max(F.size("cells")), F.lit(0))
    top = F.coalesce(F.max(F.array_max(F.transform("cells", F.abs))), F.lit(0))
    n, n_queries, dim, most = rows.agg(F.count("*"), F.count_if("asks"), size, top).first()
    limit = int(dim) * int(most) ** 2
    exact_float = limit < 1 << 53
    query_blocks = max(1, ceil(n_queries / QUERIES))
    # Each block of queries is copied to so many slots, among which the blocks of candidates are dealt.
    slots = max(1, min(ceil(n / CANDIDATES), ceil(4 * parallelism(spark) / query_blocks)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), CANDIDATES):
                part = b.iloc[i : i + CANDIDATES]
                yield pd.DataFrame({
                    "slot": [int(part["_row"].iloc[0]) % 1_000_003], "rows": [part["_row"].to_numpy("int64").tobytes()],
                    "ids": [part["vec_id"].to_numpy("int64").tobytes()], "cells": [_matrix(part["cells"], dim).tobytes()],
                })

    packed = rows.select("_row", "vec_id", "cells").mapInPandas(pack, "slot long, rows binary, ids binary, cells binary")
    candidates = written(
        packed.select(F.pmod(F.xxhash64("slot"), F.lit(slots)).cast("int").alias("slot"), "rows", "ids", "cells"), "candidates"
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    asking = rows.where("asks").select(
        "_row", "vec_id", "cells", F.pmod(F.xxhash64("_row"), F.lit(query_blocks)).cast("int").alias("block"))

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "block": [int(b["block"].iloc[0])], "q_rows": [b["_row"].to_numpy("int64").tobytes()],
            "q_cells": [_matrix(b["cells"], dim).tobytes()], "lo": [b["lo"].to_numpy("int64").tobytes()],
            "hi": [b["hi"].to_numpy("int64").tobytes()],
        })

    def scored(state: DataFrame, body, schema: str) -> DataFrame:
        """Apply ``body`` to slices of scores of all pairs of blocks; ``state`` has lo and hi of each query."""
        blocks = asking.join(state, "_row").groupBy("block").applyInPandas(
            gather, "block int, q_rows binary, q_cells binary, lo binary, hi binary")
        copies = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        pairs = candidates.join(copies, ["block", "slot"])

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kind = np.float64 if exact_float else np.int64
            for batch in batches:
                for r in batch.itertuples():
                    own, ids = np.frombuffer(r.rows, np.int64), np.frombuffer(r.ids, np.int64)
                    right = np.frombuffer(r.cells, np.int64).reshape(len(ids), dim).astype(kind)
                    asks = np.frombuffer(r.q_rows, np.int64)
                    left = np.frombuffer(r.q_cells, np.int64).reshape(len(asks), dim).astype(kind)
                    lo, hi = np.frombuffer(r.lo, np.int64), np.frombuffer(r.hi, np.int64)
                    for i in range(0, len(asks), SLICE):
                        s = slice(i, i + SLICE)
                        scores = (left[s] @ right.T).astype(np.int64)
                        yield from body(scores, asks[s][:, None] != own[None, :], asks[s], ids, lo[s], hi[s])

        return pairs.mapInPandas(work, schema)

    def histogram(scores, other, asks, ids, lo, hi):
        width = np.maximum(1, -(-(hi - lo) // BINS))
        # Bin 0 is below the interval, BINS + 1 above it.
        bins = np.clip((scores - lo[:, None]) // width[:, None], -1, BINS) + 1
        bins = np.where(scores >= hi[:, None], BINS + 1, bins)
        flat = (bins + np.arange(len(asks))[:, None] * (BINS + 2))[other]
        counts = np.bincount(flat, minlength=len(asks) * (BINS + 2)).reshape(len(asks), BINS + 2)
        # Bins under the k-th best of this block cannot hold the k-th best of all.
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pd.DataFrame({"_row": asks[q], "bin": b.astype(np.int32), "n": counts[q, b]})

    state = asking.select("_row", F.lit(-limit).alias("lo"), F.lit(limit + 1).alias("hi"))
    width = 2 * limit + 1
    while width > 1:
        counts = scored(state, histogram, "_row long, bin int, n long").groupBy("_row", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("_row").orderBy(F.desc("bin"))
        at = counts.withColumn("sum", F.sum("n").over(down)).where(F.col("sum") >= k).groupBy("_row").agg(
            F.max("bin").alias("bin"))
        step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / BINS))
        low = F.col("lo") + (F.col("bin") - 1) * step
        # A query with fewer than k others has no k-th score: everything of it is kept.
        state = written(
            state.join(at, "_row", "left").select(
                "_row", F.coalesce(low, F.lit(-limit)).cast("long").alias("lo"),
                F.coalesce(F.least(low + step, F.col("hi")), F.lit(-limit + 1)).cast("long").alias("hi")),
            "bounds")
        width = ceil(width / BINS)

    def keep(scores, other, asks, ids, lo, hi):
        out = []
        for i in range(len(asks)):
            above = np.flatnonzero((scores[i] > lo[i]) & other[i])
            ties = np.flatnonzero((scores[i] == lo[i]) & other[i])
            if len(ties) > k:
                ties = ties[np.argsort(ids[ties], kind="stable")[:k]]
            at = np.concatenate([above, ties])
            out.append(pd.DataFrame({"_row": asks[i], "vec_id": ids[at], "score": scores[i, at]}))
        yield pd.concat(out)

    kept = scored(state, keep, "_row long, vec_id long, score long")
    best = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asking.select("_row", F.col("vec_id").alias("query_id"))
    return ranked.join(names, "_row").select("query_id", "rank", "vec_id", "score")
