"""Hard negatives and clusters against plain versions, bounds against exact values."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marginalia.llm import clustering, negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_vectors(rng, n, dim):
    """Vectors with nulls, unsound and short ones, ties, copies of one vector, repeated ids and rows."""
    unit = lambda: [x / 3 for x in rng.standard_normal(dim).tolist()]
    common = unit()
    rows = [(i, common if i % 3 == 0 else unit(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [math.nan] * dim, 1), (n + 2, [None] * dim, 2), (n + 3, [math.inf] + [0.0] * (dim - 1), 1), (None, unit(), 1)]
    rows += [(n + 4, unit(), None), (n + 5, unit()[: dim // 2], 1), (n + 6, [], 2), (50, unit(), 3), rows[20], rows[20], (n + 7, [0.0] * dim, 0)]
    return rows


def cells(vector, scale):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(float(np.float32(x)) * scale) for x in vector]


def plain_negatives(rows, anchor, p=5, q=5):
    known = [(i, v, c, label) for i, v, label in rows if i is not None and label is not None and (c := cells(v, 256)) is not None]
    out = []
    for a, (i, _, c, label) in enumerate(known):
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(c, d)), j, lab == label) for b, (j, _, d, lab) in enumerate(known) if b != a)
        for s, j, _ in [x for x in scored if x[2]][:p]:
            fits = [(t, m) for t, m, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:q]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [3, 8, 64])
def test_hard_negatives(spark, dim, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 60)
    monkeypatch.setattr(negatives, "QUESTIONS", 40)
    rows = odd_vectors(np.random.default_rng(dim), 240, dim)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(-1) for c in ("row", "ask", "rank", "score", "cells", "block")})
    found = negatives.hard_negatives(frame.repartition(5), F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_no_rows_or_one_label(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(i, [1.0, 0.5], 1) for i in range(30)], VECTORS)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("dim", [5, 16, 64, 100])
def test_bounds_of_scores(dim):
    rng = np.random.default_rng(1)
    x, y = (np.cumsum(rng.integers(-9, 9, (50, dim)), axis=1) for _ in range(2))
    exact, last = x @ y.T, None
    finest = negatives.summaries(x, negatives.LEVELS[-1]), negatives.summaries(y, negatives.LEVELS[-1])
    for p in negatives.LEVELS:
        (m, d), (n, e) = negatives.coarser(*finest[0], dim, p), negatives.summaries(y, p)
        assert (m @ n.T - d @ e.T <= exact + 1e-6).all() and (exact <= m @ n.T + d @ e.T + 1e-6).all()
        width = (d @ e.T).sum()
        assert last is None or width <= last * (1 + 1e-9)
        last = width


def plain_clusters(rows, k, rounds, dim):
    known = [(i, c) for i, v, *_ in rows if (c := cells(v, 64)) is not None and len(c) == dim]
    seeds = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), c) for i, c in known)[:k]
    centroids = [c for _, c in seeds]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((gap(c, m), j) for j, m in enumerate(centroids)) for _, c in known]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [c for (_, c), (_, a) in zip(known, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((str(i), j, d) for (i, _), (d, j) in zip(known, assign())), key=str), centroids


@pytest.mark.parametrize(("dim", "bits"), [(2, 4), (8, 2), (64, 4)])
def test_clusters(spark, dim, bits):
    rows = odd_vectors(np.random.default_rng(dim), 300, dim)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(-1) for c in ("_row", "cells", "cluster", "distance")})
    found, centroids = clustering.clustered(frame.repartition(3), 16, 3, bits, dim)
    want, means = plain_clusters(rows, 16, 3, dim)
    assert sorted(((str(r[0]), r[1], r[2]) for r in found.collect()), key=str) == want
    assert centroids.tolist() == means


def test_cluster_facts(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 / 8) for _ in range(64)], 0) for i in range(200)]
    out = clustering.with_inertia(*clustering.clustered(spark.createDataFrame(rows, VECTORS))).collect()
    assert len(out) == 200
    for r in out:
        own = [x for x in out if x["cluster"] == r["cluster"]]
        assert r["cluster_inertia"] == sum(x["distance"] for x in own) and len({x["centroid_sha256"] for x in own}) == 1
        assert r["inertia"] == sum(x["distance"] for x in out)


def test_clusters_of_no_rows_or_few(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert clustering.with_inertia(*clustering.clustered(empty)).collect() == []
    few = spark.createDataFrame([(i, [float(i % 3)] * 64, 0) for i in range(5)], VECTORS)
    found, centroids = clustering.clustered(few)
    assert len(centroids) == 5 and {r["distance"] for r in found.collect()} == {0}


def test_cells_bound_distances_and_settle_most():
    """Clusters that lie apart are told by cells alone."""
    rng = np.random.default_rng(2)
    means = rng.integers(-40, 40, (16, 64))
    x = means[rng.integers(0, 16, 2000)] + rng.integers(-9, 9, (2000, 64))
    cuts = np.quantile(x, np.arange(1, 16) / 16, axis=0).astype(np.int64).T
    near, far = clustering.tables(means, cuts, x.min(axis=0), x.max(axis=0))
    low, high = clustering.intervals(clustering.approximation(x, cuts), near, far)
    exact = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    assert (clustering._open(low, high).sum(axis=1) == 1).mean() > 0.9


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_clustering"])
def test_vector_queries_have_sql(name):
    assert name in entry.oracle_sql()
