"""Vectors for what has none yet, newest first, a bounded batch at a time.

What is done is what the table of vectors holds: a row by chunk, with the
digest of the text and the fingerprint of the model that it was made from.  So
a run that ends anywhere is taken up by the next one without loss or
repetition, a text that was rewritten is pending again, and another model makes
everything pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.storage import keep
from convolake.streaming import sinks

BATCH = 100_000


def _made(spark: SparkSession, path: str) -> DataFrame:
    return sinks.current(spark, path, "chunk_id string, digest long, model string, embedding array<float>")


def pending(spark: SparkSession, path: str, chunks: DataFrame, model: str) -> DataFrame:
    """The ``chunks`` (chunk_id, ts, text) without a vector of their text by this model, with ``digest``."""
    named = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("digest", F.xxhash64("text"))
    done = _made(spark, path).filter(F.col("model") == model).select("chunk_id", "digest")
    return named.join(done, ["chunk_id", "digest"], "left_anti")


def ready(spark: SparkSession, path: str, model: str) -> bool:
    """Whether there is a vector by this model, without which semantic search has nothing to say."""
    return bool(_made(spark, path).filter(F.col("model") == model).limit(1).count())


def run(
    spark: SparkSession, path: str, chunks: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame], model: str,
    batch: int = BATCH, most: int | None = None,
) -> int:
    """Make vectors for up to ``most`` batches of about ``batch`` chunks; the number of batches written.

    ``chunks()`` is the table as it is when it is called: it is asked again
    before each write, and what was deleted or rewritten meanwhile is skipped.
    ``embed`` adds ``embedding`` to rows with ``text``.
    """
    todo = pending(spark, path, chunks(), model)
    total = todo.count()
    if not total:
        return 0
    parts = -(-total // batch)
    newest = [F.desc_nulls_last("ts"), F.asc("chunk_id")]
    dealt = todo.repartitionByRange(parts, *newest).withColumn("part", F.spark_partition_id())
    queue = keep(dealt.select("part", "chunk_id", "ts", "text", "digest"), "queue")
    first = sinks.next_batch(spark, path)
    write = sinks.replacing(path, ["chunk_id"])
    taken = parts if most is None else min(parts, most)
    for part in range(taken):
        rows = embed(queue.filter(F.col("part") == part))
        rows = rows.select("chunk_id", "digest", F.lit(model).alias("model"), F.col("embedding").cast("array<float>").alias("embedding"))
        now = chunks().select(F.col("chunk_id").cast("string").alias("chunk_id"), F.xxhash64("text").alias("digest"))
        write(sinks.still_so(rows, now, ["chunk_id"], "digest"), first + part)
    return taken


def nearest(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(chunk_id, embedding) by this model alone."""
    return _made(spark, path).filter(F.col("model") == model).select("chunk_id", "embedding")
