"""How input rows are laid out over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPLIT_BYTES = 128 * 1024 * 1024
# Beyond this a size is a placeholder for "unknown", not an estimate.
UNKNOWN_BYTES = 1 << 60


def input_bytes(rows: DataFrame) -> int | None:
    """Estimated size of everything a plan reads, if known; a join's own estimate would be a product."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < UNKNOWN_BYTES else None


def spread(rows: DataFrame) -> DataFrame:
    """Give every slot a share of an input too small to fill the cluster by its file splits.

    A small file is often one row group and would run as one task. Beyond one split per slot the scan
    is parallel already and the rows stay where they are.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(rows)
    return rows.repartition(slots) if size is not None and size < slots * SPLIT_BYTES else rows


def spread_by(rows: DataFrame, key: str, split: int = SPLIT_BYTES) -> DataFrame:
    """Hash rows by ``key`` into a fixed number of tasks for work that then stays within the key.

    The number follows the size of the input, a task for each ``split`` bytes. Adaptive execution would judge by bytes and merge the
    partitions of a small but costly input into one task; a number given outright is left alone.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-(input_bytes(rows) or 0) // split)), key)
