"""Streaming forms of ingest: each trigger takes what has arrived and adds what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feeds import to_items
from ..sources.sinks import append_items


def ingest_entries(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, fmt: str = "parquet"):
    """Run one trigger over all raw entries that arrived; a repeated batch adds nothing.

    Early and late entries are kept: an item is filed under its published date.
    """
    entries = spark.readStream.schema(schema).format(fmt).load(source)

    def add(batch: DataFrame, _: int) -> None:
        append_items(to_items(batch), root)

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_events(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Events without repeats of a key that arrive within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, size: str, slide: str, delay: str, by: list[str]) -> DataFrame:
    """Counts and sums of ``value`` in sliding windows; on a batch the watermark has no effect."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, size, slide), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, delay: str, key: str) -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    w = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key)
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Drive a stream to the end of what is there and hand each batch to ``sink``."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
