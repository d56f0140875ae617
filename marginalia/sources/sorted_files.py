"""Tables sorted by a key, with the key range of every file in a small table beside them.

A few keys, or the rows that follow a key, are then read from the files that hold them; no other file is opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file at most.
ROWS_PER_FILE = 20_000


def write_sorted(rows: DataFrame, path: str, ranges_path: str, *key: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``rows`` in order of ``key`` and the ``file, first, last, rows`` of each file; returns the table as read back.

    Equal keys may lie on both sides of a border, so a key with many rows spans as many files as it needs.
    """
    spark = rows.sparkSession
    laid = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    laid.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    at = F.struct(*key)
    ranges = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"))
    ranges.write.parquet(ranges_path)
    return back


def read_files(spark: SparkSession, path: str, files: Sequence[str], schema) -> DataFrame:
    """The rows of the named files of a table."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in files])


def holding(ranges: DataFrame, key: str, values: Sequence) -> list[str]:
    """Names of the files whose range of a single-column ``key`` takes in one of ``values``."""
    if not values:
        return []
    wanted = F.array(*[F.lit(v) for v in sorted(set(values))])

    def inside(value: Column) -> Column:
        return (value >= F.col(f"first.{key}")) & (value <= F.col(f"last.{key}"))

    return sorted(r["file"] for r in ranges.where(F.exists(wanted, inside)).select("file").collect())
