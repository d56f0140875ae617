"""Shared folder, written tables and row numbers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import checkpoint_root


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and the table survives a lost executor."""
    spark = rows.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{label}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def written_small(rows: DataFrame, label: str) -> DataFrame:
    """As ``written``, for tables of a few numbers a row: a sixteenth of the partitions holds as many bytes as others do."""
    return written(rows.coalesce(max(1, parallelism(rows.sparkSession) // 16)), label)


#: Bytes of rows that go to a Python worker at a time, where texts are among them.
BATCH_BYTES = "8m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile send texts to Python in small batches: both ends hold each one several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def numbered(rows: DataFrame, label: str, column: str = "_row") -> DataFrame:
    """A written copy in which every row, repeated ones too, has a number that no retry can change."""
    return written(rows.withColumn(column, F.monotonically_increasing_id()), label)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shielded(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names of our own, which no internal name resembles, and the new name of each column."""
    names = {c: f"given_{i}" for i, c in enumerate(rows.columns)}
    return rows.toDF(*names.values()), names


def unshielded(rows: DataFrame, names: dict[str, str], extra: dict[str, Column]) -> DataFrame:
    """The columns under their given names, then ``extra``; a given column that has the name of an extra one gives way."""
    given = [F.col(inner).alias(c) for c, inner in names.items() if c not in extra]
    return rows.select(*given, *[e.alias(c) for c, e in extra.items()])


#: Bytes of text that a task handles at a time.
SLICE = 4 << 20


def slices(sizes: Iterable[int]) -> Iterator[slice]:
    """Runs of rows of about ``SLICE`` bytes in all."""
    first = total = n = 0
    for n, size in enumerate(sizes, 1):  # noqa: B007
        total += size
        if total >= SLICE:
            yield slice(first, n)
            first, total = n, 0
    if n > first:
        yield slice(first, n)
