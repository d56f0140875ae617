"""Centroid clustering with a VA-file.

Each component of a vector is also kept as the number of a cell: ``BITS`` bits, cells of each dimension cut at quantiles of the
data. For a centroid, a lookup table holds the least and the largest squared difference of each cell of each dimension, so the sum
of table entries bounds a vector's distance from both sides. A vector is assigned by its cells alone if the interval of one
centroid lies below all others; whole vectors are fetched only where intervals overlap, and compared with those centroids only.

The sums behind the centroids follow what moves: after the first round only vectors that change their cluster are fetched for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import numbered, written
from marginalia.llm.topk import quantised

BITS = 4
CENTROIDS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Relative error of the quantiles at which cells are cut; it touches only how tight the bounds are.
ACCURACY = 1000
#: Rows of a batch that are held as matrices at a time.
SLICE = 4096


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``cells``, the floor of ``scale`` times each component, of vectors of ``dim`` finite components."""
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector_col}`"), scale).alias("cells"))
    return rows.where(F.size("cells") == dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The list column of a batch as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _cut_points(rows: DataFrame, dim: int, bits: int) -> np.ndarray:
    """Borders of the cells: dim x (2^bits - 1), from quantiles of all rows. They reach the driver as so many numbers."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    asked = [F.percentile_approx(F.col("cells")[d], shares, ACCURACY).alias(f"d{d}") for d in range(dim)]
    found = rows.agg(*asked).first()
    return np.array([x if x is not None else [0] * len(shares) for x in found], dtype=np.int64).reshape(dim, len(shares))


def approximation(cells: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cell number of each component: how many borders are at or below it."""
    out = np.empty(cells.shape, np.uint8)
    for d in range(cells.shape[1]):
        out[:, d] = np.searchsorted(cuts[d], cells[:, d], side="right")
    return out


def tables(centroids: np.ndarray, cuts: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables (dimension, cell, centroid) of the least and the largest squared difference to any value of the cell.

    The outer cells end at the least and the largest value of the dimension.
    """
    low = np.concatenate([least[:, None], cuts], axis=1)[:, :, None]
    high = np.concatenate([cuts - 1, most[:, None]], axis=1)[:, :, None]
    c = centroids.T[:, None, :]
    outside = np.maximum(np.maximum(low - c, c - high), 0)
    far = np.maximum(np.abs(c - low), np.abs(c - high))
    return outside**2, far**2


def intervals(approx: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distance of each vector from each centroid."""
    low = np.zeros((len(approx), near.shape[2]), np.int64)
    high = np.zeros_like(low)
    for d in range(approx.shape[1]):
        low += near[d][approx[:, d]]
        high += far[d][approx[:, d]]
    return low, high


def _open(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest: their interval begins at or below the end of the lowest-ending one."""
    return low <= high.min(axis=1)[:, None]


def nearest(cells: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest open centroid of each vector; of equals the smaller number."""
    best, at = np.full(len(cells), np.iinfo(np.int64).max), np.zeros(len(cells), np.int64)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        gap = ((cells[rows] - centroids[c]) ** 2).sum(axis=1)
        closer = gap < best[rows]
        best[rows[closer]], at[rows[closer]] = gap[closer], c
    return at, best


class _Sums:
    """Sums and counts by cluster of the rows of one task, as one small table at its end."""

    SCHEMA = "cluster int, sums array<long>, n long"

    def __init__(self, k: int, dim: int):
        self.sums, self.n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)

    def add(self, cells: np.ndarray, cluster: np.ndarray, sign: int = 1) -> None:
        for c in np.unique(cluster):
            own = cluster == c
            self.sums[c] += sign * cells[own].sum(axis=0)
            self.n[c] += sign * own.sum()

    def batch(self) -> pa.RecordBatch:
        used = np.flatnonzero((self.n != 0) | (self.sums != 0).any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([list(self.sums[c]) for c in used], pa.list_(pa.int64())), pa.array(self.n[used], pa.int64())],
            names=["cluster", "sums", "n"])


def _totals(parts: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """All tasks' sums added up by Spark: k rows of dim numbers."""
    added = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dim)]
    sums, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():
        n[r["cluster"]] = r["n"]
        sums[r["cluster"]] = [r[f"s{d}"] for d in range(dim)]
    return sums, n


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def clustered(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, bits: int = BITS, dim: int = DIM, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Each kept vector with ``cluster`` and squared ``distance``, and the final centroids.

    The centroids start as the ``k`` vectors whose ids have the smallest hashes (all, if there are fewer; of equal ids the vector
    that sorts first). Of equally near centroids the smaller number wins; a centroid without vectors stays. Vectors that are null, of
    another width, or hold a null or non-finite component take no part; a null id is one among others, repeated rows
    are rows of their own. No rows give no rows. ``floor(scale * x)`` must stay within 24 bits.
    """
    chosen = kept_vectors(vectors, id_col, vector_col, dim, scale)
    rows = numbered(chosen, "vectors")
    seeds = rows.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "cells")
    centroids = np.array([r["cells"] for r in seeds.orderBy("h", "cells").limit(k).collect()], dtype=np.int64).reshape(-1, dim)
    k = len(centroids)
    ends = rows.agg(*[f(F.col("cells")[d]) for f in (F.min, F.max) for d in range(dim)]).first()
    least, most = (np.array([x or 0 for x in ends[i : i + dim]], dtype=np.int64) for i in (0, dim))
    cuts = _cut_points(rows, dim, bits)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            approx = approximation(_matrix(b.column("cells"), dim), cuts)
            packed = np.packbits(np.unpackbits(approx[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(approx), -1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), b.column("vec_id"), pa.array([x.tobytes() for x in packed], pa.binary()), b.column("cells")],
                names=["_row", "vec_id", "approx", "cells"])

    file = written(
        rows.select("_row", "vec_id", "cells").mapInArrow(compress, "_row long, vec_id long, approx binary, cells array<long>"), "va-file")

    def unpacked(column: pa.Array) -> np.ndarray:
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        cells = np.unpackbits(flat, axis=1)[:, : dim * bits].reshape(len(column), dim, bits)
        return (cells * (1 << np.arange(bits)[::-1]).astype(np.uint8)).sum(axis=2, dtype=np.uint8)

    def bounded(current: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        near, far = tables(current, cuts, least, most)
        return lambda b: _open(*intervals(unpacked(b.column("approx")), near, far))

    def first_round(current: np.ndarray) -> Callable:
        open_of = bounded(current)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                at, _ = nearest(_matrix(b.column("cells"), dim), current, open_of(b))
                yield pa.RecordBatch.from_arrays(
                    [b.column("_row"), b.column("approx"), pa.array(at, pa.int32()), b.column("cells")], names=["_row", "approx", "cluster", "cells"])

        return work

    def by_cells(current: np.ndarray) -> Callable:
        """The cluster where the cells settle it, else null; with it the open centroids as bytes of 0 and 1."""
        open_of = bounded(current)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                open_ = open_of(b)
                clear = open_.sum(axis=1) == 1
                at = pa.array(open_.argmax(axis=1), pa.int32(), mask=~clear)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_row"), b.column("approx"), b.column("cluster"), at, pa.array([x.tobytes() for x in open_], pa.binary())],
                    names=["_row", "approx", "was", "cluster", "open"])

        return work

    def settle(current: np.ndarray) -> Callable:
        """Fetched vectors: the nearest of the open centroids where cells left several."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _pieces(batches):
                open_ = np.frombuffer(b"".join(b.column("open").to_pylist()), np.bool_).reshape(b.num_rows, k)
                at, _ = nearest(_matrix(b.column("cells"), dim), current, open_)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_row"), b.column("approx"), b.column("was"), pa.array(at, pa.int32()), b.column("cells")],
                    names=["_row", "approx", "was", "cluster", "cells"])

        return work

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(k, dim)
        for b in _pieces(batches):
            cells = _matrix(b.column("cells"), dim)
            sums.add(cells, b.column("cluster").to_numpy(zero_copy_only=False))
            if "was" in b.schema.names:
                sums.add(cells, b.column("was").to_numpy(zero_copy_only=False), -1)
        yield sums.batch()

    def moved(sums: np.ndarray, n: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], before)

    sums = n = state = None
    for turn in range(rounds if k else 0):
        if turn == 0:
            # Every vector counts towards the first sums, so this round reads both columns in one scan.
            found = file.select("_row", "approx", "cells").mapInArrow(
                first_round(centroids), "_row long, approx binary, cluster int, cells array<long>")
            placed = written(found, "assigned")
            sums, n = _totals(placed.select("cluster", "cells").mapInArrow(summed, _Sums.SCHEMA), k, dim)
            state = placed.select("_row", "approx", "cluster")
        else:
            bounds = written(state.mapInArrow(by_cells(centroids), "_row long, approx binary, was int, cluster int, open binary"), "bounds")
            stays = bounds.where(F.col("cluster") == F.col("was"))
            asks = bounds.where(F.col("cluster").isNull() | (F.col("cluster") != F.col("was")))
            fetched = written(
                asks.join(file.select("_row", "cells"), "_row").select("_row", "approx", "was", "open", "cells").mapInArrow(
                    settle(centroids), "_row long, approx binary, was int, cluster int, cells array<long>"), "fetched")
            change = fetched.where("cluster <> was").select("cluster", "was", "cells")
            more, count = _totals(change.mapInArrow(summed, _Sums.SCHEMA), k, dim)
            sums, n = sums + more, n + count
            state = written(
                stays.select("_row", "approx", "cluster").unionByName(fetched.select("_row", "approx", "cluster")), "assigned")
        centroids = moved(sums, n, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distances are part of the result, so each vector is read once more, but compared with open centroids only."""
        open_of = bounded(centroids)
        for b in _pieces(batches):
            at, gap = nearest(_matrix(b.column("cells"), dim), centroids, open_of(b))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(at, pa.int32()), pa.array(gap, pa.int64())], names=["vec_id", "cluster", "distance"])

    schema = "vec_id long, cluster int, distance long"
    out = file.select("vec_id", "approx", "cells").mapInArrow(last, schema) if k else rows.sparkSession.createDataFrame([], schema)
    return out, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The distances summed over each cluster and over all, and a digest of each row's centroid."""
    rows = written(assigned, "clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    whole = sum(r["cluster_inertia"] for r in per)
    known = {r["cluster"]: r["cluster_inertia"] for r in per}
    facts = rows.sparkSession.createDataFrame(
        [(c, known[c], whole, d) for c, d in digests if c in known],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
