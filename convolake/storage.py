"""Tables between jobs, kept where every executor can read them.

A written table cuts lineage as ``checkpoint()`` does, but keeps column
pruning and statistics.  The folder is the one that the cluster names in
``spark.checkpoint.dir``; a local session without that setting gets a folder of
this machine, and a cluster without it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.conf.get("spark.master", "") + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/convolake/{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(path: str, number: int, tables: dict[str, DataFrame]) -> None:
    """Write ``tables`` as release ``number``; readers see all of them or none, since the list of releases is written last."""
    spark = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/release={number}/{name}")
        spark = df.sparkSession
    if spark is not None:
        done = spark.createDataFrame([(number,)], "number long")
        done.coalesce(1).write.mode("append").parquet(f"{path}/releases")


def released(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as of the newest release."""
    newest = spark.read.parquet(f"{path}/releases").groupBy().max("number").first()[0]
    return spark.read.parquet(f"{path}/release={newest}/{name}")
