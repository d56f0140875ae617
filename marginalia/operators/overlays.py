"""Short-lived corrections over a catalog that lags behind: removals, renames, count changes.

Overlays are rows ``kind, key, value, deadline``; a row counts while its deadline lies ahead.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind string, key bigint, value string, deadline timestamp"
TTL_SECONDS = 60
REMOVED, RENAMED, COUNT = "removed", "renamed", "count"


def active(overlays: DataFrame, now: datetime | Column) -> DataFrame:
    """Rows whose deadline has not passed: the latest per key, except that count changes add up."""
    moment = now if isinstance(now, Column) else F.lit(now)
    alive = overlays.where(F.col("deadline") > moment)
    return alive.groupBy("kind", "key").agg(
        F.max_by("value", "deadline").alias("value"),
        F.max("deadline").alias("deadline"),
    )


def count_deltas(overlays: DataFrame, now: datetime | Column) -> DataFrame:
    """Sum of the count changes per folder while the newest of them is alive."""
    moment = now if isinstance(now, Column) else F.lit(now)
    sums = overlays.where(F.col("kind") == COUNT).groupBy("key").agg(
        F.sum(F.col("value").cast("bigint")).alias("delta"), F.max("deadline").alias("deadline")
    )
    return sums.where(F.col("deadline") > moment).select("key", "delta")


def without_removed(folders: DataFrame, alive: DataFrame) -> DataFrame:
    gone = alive.where(F.col("kind") == REMOVED).select(F.col("key").alias("pk"))
    return folders.join(gone, "pk", "left_anti")


def apply_renames(folders: DataFrame, alive: DataFrame) -> DataFrame:
    """Renamed folders take their new path; the paths below them follow.

    Every path is joined to its own prefixes, so each folder meets the renames above it by equality.
    The longest renamed prefix decides.
    """
    renames = alive.where(F.col("kind") == RENAMED).select(F.col("key").alias("pk"), F.col("value").alias("new_path"))
    direct = folders.join(renames, "pk", "left")
    moved = folders.join(renames, "pk").select(F.col("path").alias("prefix"), F.col("new_path").alias("new_prefix"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    prefixes = direct.where(F.col("new_path").isNull() & (F.size(parts) > 1)).select("pk", "path", F.explode(above).alias("prefix"))
    followed = prefixes.join(moved, "prefix").groupBy("pk").agg(
        F.max_by(
            F.concat("new_prefix", F.substring("path", F.length("prefix") + 1, F.length("path"))), F.length("prefix")
        ).alias("followed")
    )
    path = F.coalesce("new_path", "followed", "path")
    name = F.when(F.col("new_path").isNotNull(), F.substring_index("new_path", "/", -1)).otherwise(F.col("name"))
    return direct.join(followed, "pk", "left").withColumns({"path": path, "name": name}).drop("new_path", "followed")


def with_deadline(rows: DataFrame, at: Column, seconds: int = TTL_SECONDS) -> DataFrame:
    """Overlay rows of events ``kind, key, value`` that happened ``at``."""
    return rows.withColumn("deadline", at + F.expr(f"interval {seconds} seconds"))
