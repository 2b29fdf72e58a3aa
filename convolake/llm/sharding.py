"""Placing documents on shards by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size,
``(offset + i * skip) mod size``.  The shards take turns, each claiming the
first slot of its permutation that is still free, until the table is full; so
shares differ by at most one slot for equal weights, and when a shard leaves,
most slots keep their shard.  A shard of weight w claims w slots in its turn.

The table has ``TABLE_SIZE`` rows whatever the data, so it is broadcast, and a
document finds its shard by one hash and one lookup, without a shuffle.

A null key goes to the slot of the empty string; equal keys always meet on one
shard.  Repeated rows and extra columns pass through; no documents give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.storage import table

TABLE_SIZE = 65_537
SHARDS = 64


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8])


def lookup(weights: dict[str, int], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot; ``weights`` gives each shard's slots a turn, and sorted names take turns."""
    names = sorted(n for n, w in weights.items() if w > 0)
    if not names:
        raise ValueError("no shard has a weight above 0")
    if size < sum(weights[n] for n in names) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime of at least the sum of weights")
    slot = {n: _hash(n, "offset") % size for n in names}
    skip = {n: _hash(n, "skip") % (size - 1) + 1 for n in names}
    found: list[str | None] = [None] * size
    free = size
    while free:
        for name in names:
            for _ in range(min(weights[name], free)):
                at = slot[name]
                while found[at] is not None:
                    at = (at + skip[name]) % size
                found[at] = name
                slot[name] = (at + skip[name]) % size
                free -= 1
    return found  # type: ignore[return-value]


def slot(key: str, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 15 hex digits of its text's MD5, modulo the table's size."""
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def placed(docs: DataFrame, weights: dict[str, int], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``, in place of columns of these names."""
    rows = list(enumerate(lookup(weights, size)))
    slots = docs.sparkSession.createDataFrame(rows, "slot int, shard string")
    return docs.withColumn("slot", slot(key, size)).drop("shard").join(F.broadcast(slots), "slot")


def write(docs: DataFrame, weights: dict[str, int], path: str, key: str = "doc_id", max_rows: int = 1_000_000) -> None:
    """Write ``docs`` as one folder a shard, in files of at most ``max_rows`` rows."""
    placed(docs, weights, key).write.partitionBy("shard").option("maxRecordsPerFile", max_rows).parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, shard and UTF-8 size of every document, over 64 shards of equal weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    shards = {f"shard-{k:03d}": 1 for k in range(SHARDS)}
    return placed(docs, shards).select("doc_id", "slot", "shard", F.col("n_bytes").cast("long").alias("n_bytes"))
