"""Warnings of many hubs at once: rules as expressions over measured rows.

A hub's state is one row of ``status`` and, each in a table of its own, its
devices, conflict files, imports and drift counts.  What a rule needs of these
is measured by one grouping a table; rules about single devices or categories
read their rows as they are.  A warning is (hub, rule, subject, seconds, n):
what it is about, how long it has been so, and how many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits beyond which something is worth a warning.
HEARTBEAT_SECONDS = 10 * 60
RECONCILE_SECONDS = 3600
DEVICE_SECONDS = 86400
IMPORT_SECONDS = 45 * 86400
EMBED_SECONDS = 86400
DISK_GB = 30.0
DRIFT = ("entrypoint", "record_type")


def age(ts: Column, now: Column) -> Column:
    """Seconds from ``ts`` to ``now``; null for null."""
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))


def _warned(rows: DataFrame, rules: list[tuple[str, Column, Column | None, Column | None, Column | None]]) -> DataFrame:
    kinds = ("string", "long", "long")
    each = []
    for rule, holds, *told in rules:
        subject, seconds, n = ((F.lit(None) if c is None else c).cast(kind) for c, kind in zip(told, kinds, strict=True))
        each.append(F.struct(F.lit(rule).alias("rule"), F.coalesce(holds, F.lit(False)).alias("holds"), subject.alias("subject"), seconds.alias("seconds"), n.alias("n")))
    return rows.select("hub", F.explode(F.array(*each)).alias("r")).filter("r.holds").select("hub", "r.rule", "r.subject", "r.seconds", "r.n")


def warnings(
    status: DataFrame, devices: DataFrame, conflicts: DataFrame, imports: DataFrame, drift: DataFrame, now: Column
) -> DataFrame:
    """Every condition that holds.

    ``status`` (hub, written_at, last_reconcile_at, started_at, reachable,
    disk_free_gb, pending_chunks, oldest_pending_ts), ``devices`` (hub, name,
    connected, last_seen), ``conflicts`` (hub, path), ``imports`` (hub,
    ingested_at), ``drift`` (hub, category, value, n).
    """
    c = F.col
    written, reconciled, begun = (age(c(x), now) for x in ("written_at", "last_reconcile_at", "started_at"))
    waiting = age(c("oldest_pending_ts"), now)
    of_status = [
        ("heartbeat_missing", c("written_at").isNull(), None, None, None),
        ("heartbeat_old", written > HEARTBEAT_SECONDS, None, written, None),
        ("reconcile_old", reconciled > RECONCILE_SECONDS, None, reconciled, None),
        ("never_reconciled", c("last_reconcile_at").isNull() & (begun > RECONCILE_SECONDS), None, begun, None),
        ("sync_unreachable", ~c("reachable"), None, None, None),
        ("disk_low", c("disk_free_gb") < DISK_GB, None, None, F.floor("disk_free_gb")),
        ("embedding_backlog", waiting > EMBED_SECONDS, None, waiting, c("pending_chunks")),
    ]
    unseen = age(c("last_seen"), now)
    of_devices = [
        ("device_never_seen", ~c("connected") & c("last_seen").isNull(), c("name"), None, None),
        ("device_gone", ~c("connected") & (unseen > DEVICE_SECONDS), c("name"), unseen, None),
    ]
    filed = conflicts.groupBy("hub").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    newest = imports.groupBy("hub").agg(F.max("ingested_at").alias("newest"))
    since = age(c("newest"), now)
    unknown = drift.filter(c("category").isin(*DRIFT)).groupBy("hub", "category").agg(F.sum("n").alias("n"))
    parts = [
        _warned(status, of_status),
        _warned(devices, of_devices),
        _warned(filed, [("conflict_files", c("n") > 0, c("first"), None, c("n"))]),
        _warned(newest, [("export_old", since > IMPORT_SECONDS, None, since, None)]),
        _warned(unknown, [("format_drift", c("n") > 0, c("category"), None, c("n"))]),
    ]
    return reduce(DataFrame.unionByName, parts)
