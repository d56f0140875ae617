"""Distances between stored vectors and one query vector."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _measure(query: Sequence[float], cosine: bool):
    target = [float(x) for x in query]

    @F.arrow_udf("double")
    def measure(vectors: pa.Array) -> pa.Array:
        width = len(target)
        # Vectors are flattened without a copy; callers filter out other widths.
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        block = flat.reshape(-1, width) if width else flat.reshape(len(vectors), 0)
        goal = np.asarray(target)
        if cosine:
            norms = np.linalg.norm(block, axis=1) * np.linalg.norm(goal)
            dots = block @ goal
            return pa.array(np.divide(dots, norms, out=np.zeros(len(dots)), where=norms > 0))
        return pa.array(np.sqrt(((block - goal) ** 2).sum(axis=1)))

    return measure


def l2_distance(vectors: Column, query: Sequence[float]) -> Column:
    """Euclidean distance; all vectors must have the width of the query."""
    return _measure(query, cosine=False)(vectors)


def cosine_similarity(vectors: Column, query: Sequence[float]) -> Column:
    return _measure(query, cosine=True)(vectors)


