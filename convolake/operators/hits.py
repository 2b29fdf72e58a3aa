"""Hits of conversations: message and chunk rankings fused by turn, ranked by age, capped and enriched.

Both rankings name a turn by the first chunk of its range: a message by the
chunk that covers it, a chunk by its first sibling.  A message that no chunk
covers yet stands for itself, and so do memories and notes.  Rankings are short
(``CANDIDATES`` rows each), so every join below meets a large table with few
rows, and what it looks up is filtered by them first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators import relational
from convolake.operators import retrieval as R

#: Turns of a session that share a cell of the covering join.
CELL = 64
MODES = ("hybrid", "keyword", "semantic")


def message_keys(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` (doc_id, session, seq, …) with ``key``: the turn's first chunk, or the message itself.

    ``chunks`` are (chunk_id, session, seq_start, seq_end).
    """
    of_these = chunks.join(found.select("session").distinct(), "session", "left_semi")
    met = relational.covering(found.select("doc_id", "session", "seq"), "session", "seq", of_these, "seq_start", "seq_end", "chunk_id", CELL)
    named = found.join(met.select("doc_id", "chunk_id"), "doc_id", "left")
    key = F.coalesce(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return named.withColumn("key", key).drop("chunk_id")


def chunk_keys(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` (chunk_id, session, seq_start, …) with ``key``: the smallest chunk_id of the same range."""
    firsts = chunks.join(found.select("session", "seq_start").distinct(), ["session", "seq_start"], "left_semi")
    firsts = firsts.groupBy("session", "seq_start").agg(F.min("chunk_id").alias("_first"))
    named = found.join(firsts, ["session", "seq_start"], "left")
    return named.withColumn("key", F.concat(F.lit("chunk:"), F.coalesce("_first", "chunk_id").cast("string"))).drop("_first")


def document_keys(found: DataFrame, kind: str) -> DataFrame:
    """``found`` with ``key`` for memories or notes, which stand for themselves."""
    return found.withColumn("key", F.concat_ws(":", F.lit(kind), F.col("doc_id").cast("string")))


def best_of(ranked: DataFrame, source: str) -> DataFrame:
    """(key, rank, source, session, seq, ts, doc_id, chunk_id): each key once, at its best rank."""
    wanted = ("session", "seq", "ts", "doc_id", "chunk_id")
    whole = ranked.select("key", "rank", *[F.col(c) if c in ranked.columns else F.lit(None).alias(c) for c in wanted])
    return whole.groupBy("key").agg(F.min_by(F.struct("*"), "rank").alias("r")).select("r.*").withColumn("source", F.lit(source))


def fused(rankings: list[DataFrame], now: datetime, limit: int = 10, cap: int = R.MAX_PER_SESSION, exempt: Column | None = None) -> DataFrame:
    """The ``limit`` best keys of rankings as ``best_of`` gives them, with ``final``, ``matched`` and where each was found first.

    A key that two rankings have takes session, place and time from the one
    that was given first; at most ``cap`` keys of a session stay, unless ``exempt``.
    """
    every = None
    for at, ranking in enumerate(rankings):
        placed = ranking.withColumn("at", F.lit(at))
        every = placed if every is None else every.unionByName(placed)
    order = F.struct("at", "rank")
    merged = every.groupBy("key").agg(
        F.sum(1.0 / (R.RRF_K + F.col("rank"))).alias("rrf"),
        F.sort_array(F.collect_set("source")).alias("matched"),
        F.min(order).alias("seen"),
        *[F.min_by(c, order).alias(c) for c in ("session", "seq", "ts")],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("doc_id", "chunk_id")],
    )
    scored = merged.withColumn("final", F.round(F.col("rrf") * R.recency(F.col("ts"), now), 6))
    by = [F.desc("final"), "seen"]
    return R.capped(scored, "session", by, cap, exempt).orderBy(*by).limit(limit)


def enriched(best: DataFrame, messages: DataFrame, chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """``best`` with role and text of its message, text of its chunk, and title and source of its session; one join a side.

    ``messages`` are (doc_id, role, text), ``chunks`` (chunk_id, piece), ``sessions`` (session, title, source).
    """
    wanted = lambda side, key, *columns: side.join(best.select(key).dropna().distinct(), key, "left_semi").select(key, *columns)
    with_message = best.join(wanted(messages, "doc_id", "role", "text"), "doc_id", "left")
    with_chunk = with_message.join(wanted(chunks, "chunk_id", "piece"), "chunk_id", "left")
    told = with_chunk.join(wanted(sessions, "session", "title", "source"), "session", "left")
    return told.withColumn("title", F.coalesce("title", F.lit("")))


def search(mode: str, keyword: DataFrame | None, semantic: DataFrame | None, now: datetime, limit: int = 10) -> DataFrame:
    """Rankings fused as the mode asks; semantic search that isn't there is an error only where it is all that is asked for."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    if mode == "semantic" and semantic is None:
        raise ValueError("there is no semantic ranking")
    rankings = [keyword] if mode != "semantic" and keyword is not None else []
    rankings += [semantic] if mode != "keyword" and semantic is not None else []
    if not rankings:
        raise ValueError("there is no ranking")
    return fused(rankings, now, limit)
