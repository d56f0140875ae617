"""Change feed to index: a stream of change rows starts index passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia import schema
from marginalia.config import ChunkerConfig
from marginalia.operators.embedding import Embedder
from marginalia.operators.indexing import Index

MIN_INTERVAL_S = 1.0


def change_feed(spark: SparkSession, path: str, columns: str = schema.CHANGES) -> DataFrame:
    """Change rows as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(columns).parquet(path)


def watch(
    feed: DataFrame,
    source: Callable[[], DataFrame],
    index: Index,
    embedder: Embedder,
    checkpoint: str,
    config: ChunkerConfig = ChunkerConfig(),
    interval_s: float | None = None,
    keyed: bool = False,
) -> StreamingQuery:
    """Run an index pass for every micro-batch that holds a change.

    The pass compares the whole source. With ``keyed``, for feeds that name every note that changed, it compares the notes of the batch
    only, unless a folder or an account changed, which may touch any note. The stream's offset advances only after the pass has published its version, so a failed pass is
    repeated for the same changes. Without an interval the query drains the feed and stops.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        kinds = [r["entity"] for r in batch.select("entity").distinct().collect()]
        if not kinds:
            return
        rows, keys = source(), None
        if keyed and kinds == [schema.ENTITY_NOTE]:
            named = batch.select(F.col("entity_pk").alias("z_pk")).distinct()
            # Deleted notes are known to the index alone.
            keys = rows.select("id", "z_pk").unionByName(index.pinned().nodes().select("id", "z_pk")).join(named, "z_pk", "left_semi").select("id")
        index.reindex(rows, embedder, config, keys)

    writer = feed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if interval_s is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{max(MIN_INTERVAL_S, interval_s)} seconds").start()
