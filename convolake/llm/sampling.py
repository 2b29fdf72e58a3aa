"""Bounded, repeatable samples of labelled documents for training on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id's text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def sample(labels: DataFrame, column: str, allowed: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, u): at most ``per_class`` documents of each class, and how many each class has.

    The documents with the smallest hashes are taken, so reruns agree.  ``u``
    is another hash, for splits.  Documents that are labelled both ways, null
    doc_ids and null labels are left out; repeated labels count once.
    """
    named = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & allowed)
    sure = named.groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("top")).filter("y = top")
    counts = {int(r["y"]): int(r["count"]) for r in sure.groupBy("y").count().collect()}
    hashed = sure.select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64(F.lit(1), "doc_id").alias("u"))
    picked = [hashed.filter(F.col("y") == y).orderBy("u", "doc_id").limit(per_class) for y in (0, 1)]
    return reduce(DataFrame.unionByName, picked).withColumn("u", F.xxhash64(F.lit(2), "doc_id")), counts
