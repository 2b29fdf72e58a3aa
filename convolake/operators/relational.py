"""Joins that Spark has no keyword for: covering ranges, as-of, conditional, one-level trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covering(points: DataFrame, key: str, at: str, ranges: DataFrame, lo: str, hi: str, name: str, width: int) -> DataFrame:
    """``points`` with the smallest ``name`` of the ranges of their key that cover ``at``; null if none does.

    Ranges are cut at multiples of ``width`` and met by equality of (key, cell),
    so a long session's rows meet only the ranges beside them.
    """
    cells = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    cut = ranges.select(key, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), name, cells.alias("_cell"))
    place = points.withColumn("_cell", F.floor(F.col(at) / width))
    met = place.join(cut, [key, "_cell"], "left").withColumn("_in", F.col(at).between(F.col("_lo"), F.col("_hi")))
    return met.groupBy(*points.columns).agg(F.min(F.when(F.col("_in"), F.col(name))).alias(name))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` at or before ``ts``, of the same key.

    Both sides go through one sort as one stream, and the last right row is
    carried forward, so the cost is a sort and not a join of ranges.
    """
    held = F.struct(*values)
    a = left.select(key, ts, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(held.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(key, ts, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_v"))
    w = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select("_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def conditional_left(left: DataFrame, right: DataFrame, on: list[str], keep: Column) -> DataFrame:
    """All of ``left``; the right side only for rows that ``keep`` admits, null for the others."""
    names = [c for c in right.columns if c not in on]
    joined = left.withColumn("_keep", keep).join(right, on, "left")
    return joined.select(*left.columns, *[F.when(F.col("_keep"), F.col(c)).alias(c) for c in names])


def children(rows: DataFrame, key: str, parent: str, *order: str) -> DataFrame:
    """(parent, child, n): the rows of each parent in order, from 1; one level."""
    tree = rows.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("parent"), F.col(key).alias("child"), *[c for c in order if c != key])
    known = rows.select(F.col(key).alias("parent"))
    w = Window.partitionBy("parent").orderBy(*[F.col("child") if c == key else F.col(c) for c in order])
    return tree.join(known, "parent", "left_semi").select("parent", "child", F.row_number().over(w).cast("long").alias("n"))
