"""Structured Streaming: event windows, sessions and deduplication; sinks and turns have modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """The stream with its time as a zoned timestamp, which watermarks need, and a watermark of ``late``."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window of ``width`` and ``keys``."""
    return timed(stream, ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), *keys, "n"
    )


def sessionized(stream: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """Counts by session: runs of a key's rows with less than ``gap`` between them."""
    return timed(stream, ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), "n"
    )


def deduplicated(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark; state is bounded by ``late``."""
    return timed(stream, ts, late).dropDuplicatesWithinWatermark(list(keys))
