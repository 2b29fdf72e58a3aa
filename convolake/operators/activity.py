"""Listings: filters, roll-ups, timelines, pages and name resolution."""

from __future__ import annotations

import base64
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, *conditions: tuple[Any, Column]) -> DataFrame:
    """``df`` under the conditions whose value is given (not None); an empty list lets nothing through."""
    for value, condition in conditions:
        if value is None:
            continue
        df = df.filter(F.lit(False) if isinstance(value, (list, tuple)) and not value else condition)
    return df


def activity(ended: str, started: str) -> Column:
    """When something was last active."""
    return F.coalesce(ended, started)


def rolled_up(groups: DataFrame, key: str, kinds: dict[str, str], count: str, last: str, *sets: str) -> DataFrame:
    """Second-level totals of grouped counts: one sum a kind, the latest time, sorted sets.

    ``kinds`` names a column for each value of ``groups.kind``.
    """
    sums = [F.sum(F.when(F.col("kind") == v, F.col(count)).otherwise(0)).alias(c) for v, c in kinds.items()]
    return groups.groupBy(key).agg(*sums, F.max(last).alias(last), *[F.sort_array(F.collect_set(s)).alias(s) for s in sets])


def listed(df: DataFrame, category: str, value: str, by: str) -> DataFrame:
    """``value (count)`` of each category as one text, in order of the value."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    item = F.concat(F.col(value).cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return counts.groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(item)), ", ").alias(category))


def timeline(parts: list[DataFrame], ts: str, key: str, n: int) -> DataFrame:
    """The ``n`` latest rows of all parts; each part is cut to its own latest first."""
    latest = [p.orderBy(F.desc(ts), F.desc(key)).limit(n) for p in parts]
    return reduce(DataFrame.unionByName, latest).orderBy(F.desc(ts), F.desc(key), "kind").limit(n)


def recent(rows: DataFrame, section: str, ts: str, key: str, n: int) -> DataFrame:
    """The ``n`` latest rows of each section."""
    at = F.row_number().over(Window.partitionBy(section).orderBy(F.desc(ts), F.desc(key)))
    return rows.withColumn("_n", at).filter(F.col("_n") <= n).drop("_n")


def page(df: DataFrame, ts: str, key: str, n: int, after: tuple[Any, Any] | None = None) -> DataFrame:
    """The next ``n`` rows in descending (ts, key) after the row ``after``: a range predicate, never an offset."""
    if after is not None:
        at, last = F.lit(after[0]).cast(df.schema[ts].dataType), F.lit(after[1])
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last)))
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def cursor(ts: Any, key: Any) -> str:
    """An opaque text for the place after a row."""
    return base64.urlsafe_b64encode(json.dumps([str(ts), key]).encode()).decode().rstrip("=")


def place(text: str) -> tuple[str, Any]:
    """The (ts, key) of a cursor; ValueError if it isn't one."""
    try:
        ts, key = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except Exception as e:
        raise ValueError("not a cursor") from e
    return ts, key


def budgeted(df: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, until their sizes would pass ``budget``; the first one always."""
    w = Window.partitionBy(group).orderBy(order)
    held = df.withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return held.filter((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")


def resolved(names: DataFrame, query: str, key: str, *columns: str) -> DataFrame:
    """Rows that equal ``query`` in some column, case ignored, or else those that begin with it."""
    low = query.lower()
    exact = reduce(lambda a, b: a | b, [F.lower(c) == low for c in columns])
    begins = reduce(lambda a, b: a | b, [F.lower(c).startswith(low) for c in columns])
    ranked = names.filter(begins).withColumn("_rank", F.when(exact, 0).otherwise(1))
    best = ranked.agg(F.min("_rank").alias("_best"))
    return ranked.crossJoin(F.broadcast(best)).filter("_rank = _best").drop("_rank", "_best")


def longest_prefix(paths: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """``paths`` with the folder of most parts that holds each; null if none does.

    A path is expanded to its ancestors and met by equality, so no pair of
    path and folder is ever compared.
    """
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select(path, F.posexplode(ups).alias("_depth", folder))
    best = each.join(folders.select(folder).distinct(), folder).groupBy(path).agg(F.max_by(folder, "_depth").alias(folder))
    return paths.join(best, path, "left")


def first_of(*columns: str) -> Column:
    """The first of several texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


WORKTREE_MARK = "--claude-worktrees-"
HOME_PREFIX = r"^-(?:home|Users)-[^-]+(?:-|$)"


def alias(key: Column, cwd: Column) -> Column:
    """A project's name from its folder's key: what follows the home, else the last two parts of the path, else of the key."""
    slug = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    or_else = lambda c, name: F.coalesce(F.nullif(slug(c), F.lit("")), F.lit(name))
    whole = F.element_at(F.split(key, WORKTREE_MARK), 1)
    parts = F.filter(F.split(F.translate(cwd, "\\", "/"), "/"), lambda p: p != "")
    last_two = lambda xs: F.array_join(F.slice(xs, F.greatest(F.size(xs) - 1, F.lit(1)), F.lit(2)), "-")
    pieces = F.split(F.btrim(whole, F.lit("-")), "-")
    return (
        F.when(whole.rlike(HOME_PREFIX), or_else(F.regexp_replace(whole, HOME_PREFIX, ""), "home"))
        .when(F.size(parts) > 0, or_else(last_two(parts), "project"))
        .otherwise(or_else(last_two(pieces), "project"))
    )


def named(keys: DataFrame, base: str, *order: str) -> DataFrame:
    """``keys`` with ``name``: the first of a base in ``order`` has the base itself, the others the next free ``base-n``, n from 2.

    A number is free unless some base is spelt so, which makes names unique.
    """
    rank = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    spelt = keys.select(F.regexp_extract(base, r"^(.*)-([1-9]\d{0,8})$", 1).alias("_of"), F.regexp_extract(base, r"-([1-9]\d{0,8})$", 1).alias("_n"))
    taken = spelt.filter("_of <> ''").groupBy(F.col("_of").alias(base)).agg(F.collect_set(F.col("_n").cast("int")).alias("_taken"))
    ranked = keys.withColumn("_rank", rank).join(taken, base, "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(2), F.col("_rank") + F.size("_taken") + 1), F.col("_taken"))
    name = F.when(F.col("_rank") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.get(free, F.col("_rank") - 2).cast("string")))
    return ranked.withColumn("name", name).select(*keys.columns, "name")
