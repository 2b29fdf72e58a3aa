"""Upkeep without MERGE: upserts, retention, vanished rows, conflict merges, compaction.

Each operation gives the table as it is afterwards, to be written beside the
old one; a reader holds one directory or the other, never a half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The newest row of each key, by partial aggregation of whole rows rather than a sort."""
    best = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(order, tie)).alias("_r"))
    return best.select("_r.*")


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """``current`` with the newest change of each key where it is strictly newer, or new."""
    new = latest(changes, key, version, key)
    names = [c for c in current.columns if c != key]
    both = current.select(key, F.struct(*names).alias("_old")).join(new.select(key, F.struct(*names).alias("_new")), key, "full")
    newer = F.col("_old").isNull() | (F.col(f"_new.{version}") > F.col(f"_old.{version}"))
    return both.withColumn("_r", F.when(F.coalesce(newer, F.lit(False)), F.col("_new")).otherwise(F.col("_old"))).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in names]
    )


def pruned(rows: DataFrame, activity: Column, cutoff: Column) -> DataFrame:
    """Rows not older than the cutoff; those without a time stay."""
    return rows.filter(activity.isNull() | (activity >= cutoff))


def vanished(known: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``known`` that are no longer ``seen``."""
    return known.join(seen.select(*keys), list(keys), "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``children`` without those whose parent is among the deleted ``parents``."""
    return children.join(parents.select(key), key, "left_anti")


def union_merged(ours: DataFrame, theirs: DataFrame, key: str, place: str, newer: Column) -> DataFrame:
    """Rows of both by key: at our place where we have the key, theirs after all of ours; ``newer`` picks theirs.

    ``newer`` sees the columns as ``o`` and ``t``.  Repeated keys count once, at their first place.
    """
    one = lambda df, to: df.groupBy(key).agg(F.min_by(F.struct("*"), place).alias(to))
    both = one(ours, "o").join(one(theirs, "t"), key, "full")
    pick = F.when(F.col("o").isNull() | (F.col("t").isNotNull() & newer), F.col("t")).otherwise(F.col("o"))
    order = F.struct(F.col("o").isNull().alias("theirs"), F.coalesce(f"o.{place}", f"t.{place}").alias("at"))
    kept = [c for c in ours.columns if c not in (key, place)]
    return both.select(key, order["theirs"].alias("added"), order["at"].alias(place), *[pick[c].alias(c) for c in kept])


def without_stale(theirs: DataFrame, ours: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """``theirs`` without rows that we don't have and whose target isn't ``live``: archived or deleted ones don't come back."""
    held = ours.select(key).unionByName(live.select(key)).distinct()
    return theirs.join(held, key, "left_semi")


def recoverable(versions: DataFrame, live: DataFrame, archived: DataFrame, path: str, ts: str, cutoff: Column) -> DataFrame:
    """The latest version of each lost file within retention that is neither live nor archived as new."""
    best = versions.groupBy(path).agg(F.max(ts).alias(ts)).filter(F.col(ts) >= cutoff)
    lost = best.join(live.select(path), path, "left_anti")
    old = archived.select(F.col(path).alias("_p"), F.col(ts).alias("_t"))
    return lost.join(old, (F.col(path) == F.col("_p")) & (F.col("_t") >= F.col(ts)), "left_anti")


def prioritized(parts: list[tuple[int, DataFrame]], key: str) -> DataFrame:
    """Rows of several sources, one for each key: that of the smallest priority."""
    every = None
    for priority, df in parts:
        marked = df.withColumn("_priority", F.lit(priority))
        every = marked if every is None else every.unionByName(marked)
    best = every.groupBy(key).agg(F.min_by(F.struct("*"), "_priority").alias("_r"))
    return best.select("_r.*").drop("_priority")


def run_all(spark: SparkSession, steps: list[tuple[str, Callable[[], object]]]) -> DataFrame:
    """(step, at, ok, detail) of maintenance steps in order; one that fails is told, and the others run all the same."""
    told = []
    for at, (name, step) in enumerate(steps):
        try:
            result = step()
            told.append((name, at, True, None if result is None else str(result)))
        except Exception as e:  # whatever it is, the steps after it don't depend on it
            told.append((name, at, False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    return spark.createDataFrame(told, "step string, at int, ok boolean, detail string")


def compacted(df: DataFrame, path: str, rows_per_file: int, *sort: str) -> None:
    """Rewrite a table in files of at most ``rows_per_file`` rows, sorted so that statistics skip well."""
    df.repartitionByRange(*sort).sortWithinPartitions(*sort).write.option("maxRecordsPerFile", rows_per_file).parquet(path)
