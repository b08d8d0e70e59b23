"""Streams: documents that arrive are folded into the index batch by batch, and log events are counted by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..plans.pipelines import Settings, synced


def into_index(docs: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "chunk", settings: Settings | None = None):
    """Starts a query that syncs each micro-batch of documents into the index.

    ``write`` gets the new index and the batch number, and must make a batch that comes again after a failure harmless,
    for example by a path that holds the number; ``read`` gives the index of the batch before.
    """

    def one(batch: DataFrame, number: int) -> None:
        write(synced(read(), batch.dropDuplicates(["document_id"]), mode, settings).drop("change"), number)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events and mean value by type and window; for streams, windows close ``late`` after their end."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    g = w.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "events", "mean_value")
