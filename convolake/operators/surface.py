"""Checks and pages at the edge: names, sizes, networks, rates, transcripts of several parts, highlighted snippets."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLUG = r"^[a-z0-9][a-z0-9_-]{0,63}$"
BODY_BYTES = 20_000
INDEX_LINES, INDEX_BYTES = 200, 25_000
RATE, RATE_SECONDS = 120, 60


def valid_name(name: Column) -> Column:
    """Whether a name may be a file's stem."""
    return F.coalesce(name.rlike(SLUG), F.lit(False))


def size_warning(text: Column) -> Column:
    """Why an index is too long to be read whole, or null."""
    n = F.size(F.split(text, "\n"))
    over_lines = F.concat(n.cast("string"), F.lit(f" lines, {INDEX_LINES} are read"))
    over_bytes = F.concat(F.octet_length(text).cast("string"), F.lit(f" bytes, {INDEX_BYTES} are read"))
    return F.when(n > INDEX_LINES, over_lines).when(F.octet_length(text) > INDEX_BYTES, over_bytes)


def address(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it isn't one."""
    parts = F.split(ip, r"\.")
    each = [F.get(parts, k).try_cast("long") for k in range(4)]
    fine = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^\d{1,3}$") & (p.try_cast("int") <= 255))
    return F.when(fine, ((each[0] * 256 + each[1]) * 256 + each[2]) * 256 + each[3])


def within(ip: Column, networks: list[str]) -> Column:
    """Whether an address lies in any of the networks, as range comparisons."""
    at, inside = address(ip), F.lit(False)
    for net in map(ipaddress.IPv4Network, networks):  # raises for others
        inside = inside | at.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(inside, F.lit(False))


def admitted(calls: DataFrame, key: str, ts: str, order: str, rate: int = RATE, seconds: int = RATE_SECONDS) -> DataFrame:
    """``calls`` with ``admitted``: fewer than ``rate`` admitted calls of the key in the ``seconds`` before.

    Only admitted calls count, so each decision hangs on those before it; null
    is a key like any other, and calls without a time count for none.  A key's calls are streamed in order, and what is held of a key is at most
    ``rate`` times.
    """
    named = calls.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    out = named.select(F.struct("*", F.lit(True).alias("admitted")).alias("r")).schema["r"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            flags = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column("_t").to_pylist(), strict=True):
                if not held or held["key"] != k:
                    held = {"key": k, "times": []}
                held["times"] = [x for x in held["times"] if t is None or x > t - seconds]
                flags.append(len(held["times"]) < rate)
                if flags[-1] and t is not None:
                    held["times"].append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "admitted"])

    return named.repartition(key).sortWithinPartitions(key, "_t", order).mapInArrow(run, out).drop("_t")


def joined_parts(messages: DataFrame, sessions: DataFrame, session: str, parent: str, seq: str) -> DataFrame:
    """(root, part, session, seq, …): each top-level session's messages, then those of its children in order of start."""
    order = Window.partitionBy(parent).orderBy("started_at", session)
    children = sessions.filter(F.col(parent).isNotNull()).select(
        F.col(parent).alias("root"), F.col(session), F.row_number().over(order).cast("long").alias("part")
    )
    tops = sessions.filter(F.col(parent).isNull()).select(F.col(session).alias("root"), F.col(session), F.lit(0).cast("long").alias("part"))
    return messages.join(tops.unionByName(children), session).select("root", "part", session, seq, *[c for c in messages.columns if c not in (session, seq)])


def text_page(text: Column, offset: int, max_chars: int) -> Column:
    """``max_chars`` from ``offset``, back to the last whole line where there is one."""
    cut = F.substring(text, offset + 1, max_chars)
    whole = F.length(cut) - F.length(F.substring_index(cut, "\n", -1))
    return F.when(F.length(text) <= offset + max_chars, cut).when(whole > 0, F.substring(cut, F.lit(1), whole)).otherwise(cut)


def numbered_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with ``unique_name``: the first of a name as it is, the next with ``-2``, ``-3`` and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def highlighted(text: Column, terms: list[str], context_chars: int = 300) -> Column:
    """The window of tokens with most hits, hits between ``**``; the text's head if there is none."""
    width = max(5, min(64, context_chars // 6))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    low = [t.lower() for t in terms]

    def best(w: Column) -> Column:
        hit = F.transform(w, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\W+|\W+$", "")).isin(low).cast("int"))

        def window(h: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - width))
            scored = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(h, i + 1, width), F.lit(0), lambda a, b: a + b).alias("n"), (-i).alias("i")))
            top = F.array_max(scored)
            marked = F.zip_with(w, h, lambda x, y: F.when(y == 1, F.concat(F.lit("**"), x, F.lit("**"))).otherwise(x))
            shown = F.array_join(F.slice(marked, 1 - top["i"], width), " ")
            lead, tail = F.when(top["i"] < 0, "…").otherwise(""), F.when(width - top["i"] < F.size(w), "…").otherwise("")
            return F.when(top["n"] > 0, F.concat(lead, shown, tail))

        return F.get(F.transform(F.array(hit), window), 0)

    head = F.concat(F.substring(text, 1, context_chars), F.when(F.length(text) >= context_chars, "…").otherwise(""))
    return F.coalesce(F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, best(w))), 0), head)
