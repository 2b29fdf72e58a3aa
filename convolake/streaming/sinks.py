"""Tables whose rows are replaced by key, a batch at a time, in the buckets that it touches.

A table is a folder of buckets, ``rows/batch=n/bucket=b``, and of manifests,
``manifest/batch=n``, which name for each bucket the batch that wrote it last.
A batch reads only the buckets that its keys fall in, writes these anew beside
the old ones, and then its manifest; readers follow the newest manifest, so
they see a batch whole or not at all, and other buckets keep their files.  A
batch that is run again finds its manifest and changes nothing; one that
failed before its manifest is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.operators.maintenance import upserted

BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("bucket int, written long, batch long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after the newest batch's, for writers that count for themselves."""
    found = _manifests(spark, path)
    newest = None if found is None else found.agg(F.max("batch")).first()[0]
    return 0 if newest is None else newest + 1


def current(spark: SparkSession, path: str, schema, before: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The table as of its newest manifest, or the newest before a batch; ``only`` some buckets."""
    empty = spark.createDataFrame([], schema)
    found = _manifests(spark, path)
    if found is None:
        return empty
    found = found if before is None else found.filter(F.col("batch") < before)
    newest = found.agg(F.max("batch")).first()[0]
    if newest is None:
        return empty
    held = found.filter((F.col("batch") == newest) & (F.col("bucket") >= 0)).select("bucket", "written").collect()  # a row a bucket
    folders = [f"{path}/rows/batch={r['written']}/bucket={r['bucket']}" for r in held if only is None or r["bucket"] in only]
    return spark.read.schema(empty.schema).parquet(*folders) if folders else empty


Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _rewriting(path: str, keys: list[str], buckets: int, merge: Merge) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the buckets of a batch's keys get what ``merge`` makes of their rows and the batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifests = _manifests(spark, path)
        if manifests is not None and manifests.filter(F.col("batch") == number).limit(1).count():
            return
        batch = batch.distinct().withColumn("bucket", _bucket(keys, buckets)).persist()
        try:
            touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # ``buckets`` rows at most
            rows = batch.drop("bucket")
            merged = merge(current(spark, path, rows.schema, before=number, only=touched), rows).select(*rows.columns)
            dealt = merged.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
            all_touched = spark.createDataFrame([(b,) for b in touched], "bucket int")
            filled = all_touched
            if touched:
                filled = spark.read.schema("bucket int").parquet(f"{path}/rows/batch={number}").select("bucket").distinct()
            told = spark.createDataFrame([(-1,)], "bucket int")  # so that a table without rows has a manifest, too
            written = filled.unionByName(told).select("bucket", F.lit(number).cast("long").alias("written"))
            before = None if manifests is None else manifests.filter(F.col("batch") < number)
            newest = None if before is None else before.agg(F.max("batch")).first()[0]
            if newest is not None:
                held = before.filter((F.col("batch") == newest) & (F.col("bucket") >= 0)).select("bucket", "written")
                written = written.unionByName(held.join(all_touched, "bucket", "left_anti"))
            written.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
        finally:
            batch.unpersist()

    return write


def replacing(path: str, keys: list[str], buckets: int = BUCKETS, gone: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: all rows with a key of the batch go, and the batch's rows come, but for those that are ``gone``.

    A key may have several rows.  Rows that repeat whole within a batch count once.
    """

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        new = batch if gone is None else batch.filter(~F.coalesce(gone, F.lit(False)))
        stays = old.join(batch.select(*keys).distinct(), keys, "left_anti")
        return stays.select(*new.columns).unionByName(new)

    return _rewriting(path, keys, buckets, merge)


def upserting(path: str, key: str, version: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each key keeps its newest row, one that is there already if none is strictly newer."""
    return _rewriting(path, [key], buckets, lambda old, batch: upserted(old, batch, key, version))


def still_so(rows: DataFrame, now: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """The ``rows`` whose ``digest`` is what ``now`` has for their key: those deleted or rewritten meanwhile are left out."""
    return rows.join(now.select(*keys, digest).distinct(), [*keys, digest], "left_semi")
