"""The change feed as a stream: micro-batches of file events, coalesced and applied to a store.

There is no watermark: an event says only that a path is to be looked at again, so late or repeated
events are harmless, and a batch that is delivered twice is recognised by its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.incremental import latest_events
from ..sources.store import Store

FEED = "project_root string, path string, event string, ts timestamp_ntz, received_at timestamp_ntz"


def feed_stream(spark: SparkSession, folder: str, files_per_batch: int = 50) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def apply_batch(events: DataFrame, store: Store, build: Callable[[DataFrame], DataFrame], batch: int | None = None) -> dict[str, int]:
    """One batch: the last event of each path, then build what changed, insert, drop what is gone.

    ``build`` gets (path) and returns index rows; a path for which it returns none is dropped too.
    """
    last = latest_events(events).persist()
    try:
        changed, gone = last.where("event = 'change'").select("path"), last.where("event = 'unlink'").select("path")
        fresh = build(changed)
        empty = changed.join(fresh.select("path").distinct(), "path", "left_anti")
        store.replace_paths(fresh, gone.union(empty), batch)
        return {"changed": changed.count(), "gone": gone.count()}
    finally:
        last.unpersist()


def run(spark: SparkSession, folder: str, store: Store, build: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True, seconds: int = 2) -> StreamingQuery:
    """Apply the feed in a folder to a store, once through or continuously."""
    writer = feed_stream(spark, folder).writeStream.foreachBatch(lambda df, n: apply_batch(df, store, build, n) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def event_counts(stream: DataFrame) -> DataFrame:
    """Events per kind, for a complete-mode sink."""
    return stream.groupBy("event").count()
