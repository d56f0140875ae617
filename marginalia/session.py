"""Session construction and the few settings the engine depends on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "marginalia",
    master: str | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the engine defaults; ``master`` is left to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster; a folder of our own only in a local session without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set; name a folder all executors share")
        root = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def settled(rows: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, free of the plan that made them."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(rows.sparkSession))
    return rows.checkpoint()


def stored(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder: columns can be pruned, filters pushed, and the size is known."""
    path = f"{checkpoint_root(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
