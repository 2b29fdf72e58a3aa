"""Memories saved, appended to and archived by batches of requests, each against the version that it names.

A request names the digest of the version that it has read (``expected``); if
the memory has another by now, it changes nothing.  Requests of a batch are
taken in order of ``seq``: the first that can be done for a memory is, and
those after it meet a version that they haven't read.  What becomes of each
request is told.

Memories are (project, name, title, description, type, body, sha256); texts are
compared and told apart by ``sha256`` of these fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolake.operators.surface import BODY_BYTES, valid_name

# What a memory may be, and how it may be saved.
TYPES = ("user", "feedback", "project", "reference")
MODES = ("create", "replace", "append")
KEY = ["project", "name"]
FIELDS = ["title", "description", "type", "body"]


def digest(*fields: str) -> Column:
    """The version of a memory."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def _given(name: str) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.col(name), r"\s+", " ")), F.lit(""))


def _first(done: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("outcome") != "done", "seq"))


def saved(memories: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories afterwards, (seq, outcome)) of requests (seq, project, name, mode, expected, title, description, type, body).

    Outcomes: ``invalid``, ``exists`` (to be created, but there), ``missing``
    (to be changed, but not there), ``changed`` (another version by now), ``done``.
    Appending keeps the fields that aren't given and adds the body after the old one.
    """
    old = memories.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in (*FIELDS, "sha256")])
    asked = requests.withColumns({c: _given(c) for c in ("title", "description", "type")}).withColumn("body", F.coalesce("body", F.lit("")))
    new, there, adds = F.col("mode") == "create", F.col("old_sha256").isNotNull(), F.col("mode") == "append"
    added = [F.regexp_replace(F.coalesce("old_body", F.lit("")), r"\s+$", ""), F.btrim("body", F.lit("\n"))]
    whole = F.when(adds, F.ltrim(F.concat_ws("\n\n", *added), F.lit("\n"))).otherwise(F.col("body"))
    both = asked.join(old, KEY, "left").withColumn("whole", whole)
    full = adds | ((F.col("title") != "") & (F.col("description") != ""))
    typed = F.col("type").isin(*TYPES) | (adds & (F.col("type") == ""))
    fine = F.col("mode").isin(*MODES) & full & typed & F.col("body").rlike(r"\S") & (F.octet_length("whole") <= BODY_BYTES) & valid_name(F.col("name"))
    outcome = (
        F.when(~F.coalesce(fine, F.lit(False)), "invalid")
        .when(new & there, "exists")
        .when(~new & ~there, "missing")
        .when(~new & ~F.col("expected").eqNullSafe(F.col("old_sha256")), "changed")
        .otherwise("done")
    )
    judged = both.withColumn("outcome", outcome)
    taken = judged.withColumn("_n", _first(judged))
    late = (F.col("outcome") == "done") & (F.col("_n") > 1)
    told = taken.withColumn("outcome", F.when(late, F.when(new, "exists").otherwise("changed")).otherwise(F.col("outcome")))

    kept = lambda c: F.when(adds & (F.col(c) == ""), F.col(f"old_{c}")).otherwise(F.col(c))
    fresh = told.filter("outcome = 'done'").select(*KEY, *[kept(c).alias(c) for c in FIELDS[:3]], F.col("whole").alias("body"))
    fresh = fresh.withColumn("sha256", digest(*FIELDS))
    stays = memories.join(fresh.select(*KEY), KEY, "left_anti")
    return stays.unionByName(fresh), told.select("seq", "outcome")


def archived(memories: DataFrame, requests: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(memories, archive rows, index, (seq, outcome)) after requests (seq, project, name, expected, reason, at).

    An archived memory keeps its fields beside why and when it went; its line,
    ``name.md`` in ``index`` (project, target, …), goes with it.
    """
    both = requests.withColumn("reason", _given("reason")).join(memories, KEY, "left")
    outcome = (
        F.when(F.col("reason") == "", "invalid").when(F.col("sha256").isNull(), "missing")
        .when(~F.col("expected").eqNullSafe(F.col("sha256")), "changed").otherwise("done")
    )
    judged = both.withColumn("outcome", outcome)
    taken = judged.withColumn("_n", _first(judged))
    late = (F.col("outcome") == "done") & (F.col("_n") > 1)
    told = taken.withColumn("outcome", F.when(late, "missing").otherwise(F.col("outcome")))
    gone = told.filter("outcome = 'done'").select(*KEY, *FIELDS, "sha256", "reason", "at")
    lines = gone.select("project", F.concat("name", F.lit(".md")).alias("target"))
    return (
        memories.join(gone.select(*KEY), KEY, "left_anti"), gone, index.join(lines, ["project", "target"], "left_anti"),
        told.select("seq", "outcome"),
    )


def with_titles(memories: DataFrame, index: DataFrame) -> DataFrame:
    """``memories`` with the title that their index line gives, else their own, else their name."""
    lines = index.select("project", "target", F.col("title").alias("_line"))
    named = memories.withColumn("target", F.concat("name", F.lit(".md"))).join(lines, ["project", "target"], "left")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return named.withColumn("title", F.coalesce(empty("_line"), empty("title"), "name")).select(*memories.columns)


def counted(counters: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Counters (keys, n) with what was ``seen`` added."""
    every = counters.select(*keys, "n").unionByName(seen.select(*keys, "n"))
    return every.groupBy(*keys).agg(F.sum("n").alias("n"))
