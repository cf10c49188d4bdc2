"""Lazy pulls of a DataFrame, and windowed counts that work on batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pull(df: DataFrame, *order: str) -> Iterator[Row]:
    """Rows one partition after the other; only one partition's rows are held at a time."""
    yield from (df.orderBy(*order) if order else df).toLocalIterator(prefetchPartitions=False)


def windowed_counts(events: DataFrame, time: str, window: str, *keys: str, lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, n): events by event-time window; later ones than ``lateness`` are left out of streams."""
    stamped = events.withColumn("__ts", F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__ts", lateness)
    grouped = stamped.groupBy(F.window("__ts", window, slide or window).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **options: Any) -> StreamingQuery:
    """Runs a stream over all there is now, exactly once for each input, and ends."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
