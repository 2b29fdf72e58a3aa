"""Turn chunks of sessions: whole, or only what has changed since the last time.

A turn begins at a session's first row and at every prompt.  Its text has what
was said, under labels, and is cut in pieces; its range covers all its rows.
The last turn may still grow, so it is chunked only once its session is quiet.

Rows are (session, seq, role, is_prompt, text, uuid, ts); other columns are
ignored.  A turn without text has no chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.operators import chunking, sessions

LABELS = {"assistant": "Assistant", "summary": "Summary"}


def label() -> Column:
    """What a row's text stands under; null for tool rows and text that nobody typed."""
    prompt = (F.col("role") == "user") & F.col("is_prompt")
    spoken = F.when(prompt, "User")
    for role, name in LABELS.items():
        spoken = spoken.when(F.col("role") == role, name)
    return spoken


def turns(rows: DataFrame, session: str = "session") -> DataFrame:
    """(session, turn_id, seq_start, seq_end, text, uuid, ts, last) of every turn; uuid and ts are its first known ones."""
    prompt = (F.col("role") == "user") & F.col("is_prompt")
    marked = sessions.turns(rows, session, "seq", prompt)
    texts = sessions.turn_texts(marked, session, "seq", label())
    anchors = sessions.anchors(marked, session, "seq", "uuid", "ts")
    # both are dealt by session and turn, so this join shuffles nothing
    found = texts.join(anchors, [session, "turn_id"])
    ends = rows.groupBy(session).agg(F.max("seq").alias("_end"))
    return found.join(ends, session).withColumn("last", F.col("seq_end") == F.col("_end")).drop("_end")


def chunks(rows: DataFrame, quiet: DataFrame | None = None, session: str = "session") -> DataFrame:
    """(session, seq_start, seq_end, uuid, ts, i, piece) of closed turns, and of the last ones of ``quiet`` sessions.

    Without ``quiet`` every session counts as quiet.
    """
    found = turns(rows, session)
    if quiet is not None:
        still = quiet.select(session, F.lit(True).alias("_quiet")).distinct()
        found = found.join(still, session, "left").filter(~F.col("last") | F.col("_quiet")).drop("_quiet")
    whole = found.select(session, "seq_start", "seq_end", "uuid", "ts", "text")
    return chunking.pieces(whole, "text")


def changes(rows: DataFrame, done: DataFrame, quiet: DataFrame, session: str = "session") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to write after more ``rows`` have come in: (new chunks, ranges that are no longer right, new progress).

    ``done`` (session, chunked_seq) is how far each session is settled.  Only
    sessions with rows beyond that are read.  Where these go on with a turn
    that was settled as a quiet tail, that turn is opened and chunked anew,
    whether it had a chunk or not.  Ranges are (session, seq_start); their
    chunks are to be deleted.
    """
    settled = F.coalesce("chunked_seq", F.lit(-1).cast("long"))
    ends = rows.groupBy(session).agg(F.max("seq").alias("_end"))
    pending = ends.join(done, session, "left").withColumn("_done", settled).filter(F.col("_end") > F.col("_done"))
    prompt = F.coalesce((F.col("role") == "user") & F.col("is_prompt"), F.lit(False))
    beyond = F.col("seq") > F.col("_done")
    each = rows.join(pending.select(session, "_done"), session).groupBy(session).agg(
        F.min_by(prompt, F.when(beyond, F.col("seq"))).alias("_new_turn"),
        F.coalesce(F.max(F.when(prompt & ~beyond, F.col("seq"))), F.min("seq")).alias("seq_start"),
    )
    reopened = each.filter(~F.col("_new_turn")).select(session, "seq_start")

    since = pending.join(reopened, session, "left").select(session, F.coalesce(F.col("seq_start") - 1, "_done").alias("_since"))
    some = rows.join(since, session).filter(F.col("seq") > F.col("_since")).drop("_since")
    found = turns(some, session)
    still = quiet.select(session, F.lit(True).alias("_quiet")).distinct()
    settled_turns = found.join(still, session, "left").withColumn("_take", ~F.col("last") | F.coalesce("_quiet", F.lit(False)))
    fresh = settled_turns.filter("_take").select(session, "seq_start", "seq_end", "uuid", "ts", "text")
    # the open turn is read again next time; with it taken, everything is settled
    progress = settled_turns.filter("last").select(
        session, F.when(F.col("_take"), F.col("seq_end")).otherwise(F.col("seq_start") - 1).alias("chunked_seq")
    )
    unchanged = done.join(progress.select(session), session, "left_anti")
    return chunking.pieces(fresh, "text"), reopened, unchanged.unionByName(progress)
