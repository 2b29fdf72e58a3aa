"""Sessions from message rows: sequence numbers, turns, carried timestamps, folds.

Every window is partitioned by session.  Windows that need the same order share
one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCERPT = 500


def _ordered(session: str, seq: str):
    return Window.partitionBy(session).orderBy(seq)


def numbered(rows: DataFrame, session: str, *order: str) -> DataFrame:
    """``rows`` with ``seq``, from 0 within each session."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long") - 1)


def turns(rows: DataFrame, session: str, seq: str, prompt: Column) -> DataFrame:
    """``rows`` with ``turn_id``: a turn begins at a session's first row and at every prompt."""
    w = _ordered(session, seq)
    begins = F.when((F.row_number().over(w) == 1) | F.coalesce(prompt, F.lit(False)), 1).otherwise(0)
    marked = rows.withColumn("_begins", begins)
    return marked.withColumn("turn_id", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def turn_texts(rows: DataFrame, session: str, seq: str, label: Column, text: str = "text") -> DataFrame:
    """(session, turn_id, seq_start, seq_end, text) of ``rows`` with ``turn_id``.

    Rows without a label or text only count for the range.  Neighbouring
    Assistant texts share one label.
    """
    named = rows.withColumn("_label", F.when(F.trim(F.coalesce(text, F.lit(""))) != "", label)).withColumn("_text", F.btrim(text))
    spoken = F.collect_list(F.when(F.col("_label").isNotNull(), F.struct(F.col(seq).alias("s"), F.col("_label").alias("l"), F.col("_text").alias("t"))))
    held = named.groupBy(session, "turn_id").agg(
        F.min(seq).alias("seq_start"), F.max(seq).alias("seq_end"), F.sort_array(spoken).alias("parts")
    )
    joined = F.transform(
        "parts",
        lambda p, i: F.when(
            (i > 0) & (p["l"] == "Assistant") & (F.get("parts", i - 1)["l"] == "Assistant"), p["t"]
        ).otherwise(F.concat(p["l"], F.lit(": "), p["t"])),
    )
    return held.select(session, "turn_id", "seq_start", "seq_end", F.array_join(joined, "\n\n").alias("text"))


def anchors(rows: DataFrame, session: str, seq: str, *columns: str) -> DataFrame:
    """The first value that isn't null of each of ``columns``, on its own, for each turn."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns]
    return rows.groupBy(session, "turn_id").agg(*firsts)


def closed(rows: DataFrame, session: str, quiet: Column | None = None) -> DataFrame:
    """Rows of turns that can't grow any more: all but a session's last one, unless the session is ``quiet``."""
    marked = rows.withColumn("_last", F.max("turn_id").over(Window.partitionBy(session)))
    done = F.col("turn_id") < F.col("_last")
    return marked.filter(done if quiet is None else done | quiet).drop("_last")


def carried(rows: DataFrame, session: str, seq: str, ts: str) -> DataFrame:
    """``rows`` with missing ``ts`` filled from the row before; leading ones take the first that is known."""
    w = _ordered(session, seq)
    back = F.last(ts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(ts, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(ts, F.coalesce(back, ahead))


def folded(rows: DataFrame, session: str, seq: str, prompt: Column, reply: Column, text: str = "text") -> DataFrame:
    """One row a session: counts, first and last prompt and last reply as excerpts."""
    cut = F.substring(text, 1, EXCERPT)
    at = lambda cond: F.when(cond, F.col(seq))
    return rows.groupBy(session).agg(
        F.count("*").alias("n_rows"),
        F.count_if(prompt).alias("n_prompts"),
        F.count_if(reply).alias("n_replies"),
        F.min_by(cut, at(prompt)).alias("first_prompt"),
        F.max_by(cut, at(prompt)).alias("last_prompt"),
        F.max_by(cut, at(reply)).alias("final_reply"),
    )


def facts(rows: DataFrame, session: str, order: Column, *columns: str) -> DataFrame:
    """The last value that isn't null of each column, for each session."""
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return rows.groupBy(session).agg(*lasts)


def summary(compact: Column, plain: Column, order: Column) -> Column:
    """An aggregate: the latest compaction summary, or else the latest plain one."""
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), order))
    return F.coalesce(latest(compact), latest(plain))
