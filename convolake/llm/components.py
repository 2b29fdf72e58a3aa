"""Connected components by alternating large and small stars.

Edges live in a DataFrame and every round is two groupings and two joins, so
no vertex list, edge list or component passes through the driver.  A hub with
a third of all edges is pre-aggregated by ``min`` and its join is one that
adaptive execution may split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from convolake.storage import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each vertex to its smallest neighbour.

    ``edges`` has u > v.  The large star moves the larger neighbours, the
    small star the smaller ones and the vertex itself.
    """
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = edges.unionByName(flipped) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = flipped.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``edges`` written and read back, with a digest that is taken as they are written."""
    seen = Observation()
    digest = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    written = keep(edges.observe(seen, *digest), name)
    return written, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every vertex of an edge; root is the smallest vertex reachable.

    Vertices may have any orderable type.  Edges with a null end and loops
    are ignored; repeated edges count once; no edges give no rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    cur = ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u > v")
    cur, before = _kept(cur.distinct(), "edges")
    while before[0]:
        cur, after = _kept(_star(_star(cur, True), False), "stars")
        if after == before:
            break
        before = after
    roots = cur.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def spanning(alike: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) for all but the first of each component of a symmetric matrix of a block's links."""
    left, found = np.ones(len(alike), bool), []
    for seed in np.flatnonzero(alike.any(axis=1)).tolist():
        front = np.array([seed]) if left[seed] else np.empty(0, int)
        left[seed] = False
        while len(front):
            front = np.flatnonzero(alike[front].any(axis=0) & left)
            left[front] = False
            found += [(int(x), seed) for x in front]
    return found
