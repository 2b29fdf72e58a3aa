"""Changes of one key that reach several tables: re-assigned keys, automated flags, title documents.

Each gives all tables as they are afterwards, from one mapping, so that they
agree; ``storage.release`` makes them visible together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reassigned(keys: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys afterwards, moves by key, emptied projects) of ``changes`` (key, project_id) to ``keys`` (key, project_id).

    Moves are (key, old_id, new_id).  A project whose last key has moved is
    emptied; all that is left of it goes where the largest key that moved went.
    """
    to = changes.groupBy("key").agg(F.max("project_id").alias("new_id"))
    both = keys.join(to, "key", "full").withColumn("now", F.coalesce("new_id", "project_id"))
    moves = both.filter((F.col("project_id") != F.col("now"))).select("key", F.col("project_id").alias("old_id"), F.col("now").alias("new_id"))
    after = both.select("key", F.col("now").alias("project_id"))
    emptied = moves.join(after.select(F.col("project_id").alias("old_id")), "old_id", "left_anti")
    return after, moves, emptied.groupBy("old_id").agg(F.max_by("new_id", "key").alias("new_id"))


def moved_rows(rows: DataFrame, moves: DataFrame, emptied: DataFrame, key: str = "project_key") -> DataFrame:
    """``rows`` that carry their own ``key`` beside project_id, as after the moves: by key first, then by emptied project."""
    by_key = moves.select(F.col("key").alias("_key"), F.col("old_id").alias("_old"), F.col("new_id").alias("_by_key"))
    joined = rows.join(by_key, (F.col(key) == F.col("_key")) & (F.col("project_id") == F.col("_old")), "left")
    joined = joined.withColumn("project_id", F.coalesce("_by_key", "project_id")).select(*rows.columns)
    return moved_projects(joined, emptied)


def moved_projects(rows: DataFrame, emptied: DataFrame, pending: str | None = None) -> DataFrame:
    """``rows`` with a project_id, as after the moves; ``pending``, a flag, becomes true in those that moved."""
    to = emptied.select(F.col("old_id").alias("project_id"), F.col("new_id").alias("_new"))
    joined = rows.join(to, "project_id", "left")
    moved = joined.withColumn("project_id", F.coalesce("_new", "project_id"))
    if pending:
        moved = moved.withColumn(pending, F.col(pending) | F.col("_new").isNotNull())
    return moved.select(*rows.columns)


def remaining(projects: DataFrame, emptied: DataFrame) -> DataFrame:
    """``projects`` (project_id, created_by, …) without emptied ones that no configuration names."""
    gone = emptied.select(F.col("old_id").alias("project_id"), F.lit(True).alias("_gone"))
    joined = projects.join(gone, "project_id", "left")
    return joined.filter(F.col("_gone").isNull() | (F.col("created_by") == "config")).select(*projects.columns)


def flagged(docs: DataFrame, sessions: DataFrame, kind: str = "automated") -> DataFrame:
    """``docs`` with ``automated`` as their session's kind has it now; others keep what they have."""
    now = sessions.select("session", (F.col("kind") == kind).alias("_now"))
    joined = docs.join(now, "session", "left")
    return joined.withColumn("automated", F.coalesce("_now", "automated")).select(*docs.columns)


def titled(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """``docs`` (doc_type, session, text) with one document of type ``session`` for each titled session, and no older one."""
    named = sessions.filter(F.coalesce("title", F.lit("")) != "").select("session", "title")
    stale = (F.col("doc_type") == "session").eqNullSafe(F.lit(True))
    others = docs.join(named.select("session", F.lit(True).alias("_named")), "session", "left").filter(~(stale & F.coalesce("_named", F.lit(False))))
    made = named.select(F.lit("session").alias("doc_type"), "session", F.col("title").alias("text"))
    return others.select("doc_type", "session", "text").unionByName(made)
