"""Session queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import sessions as S
from convolake.storage import table


def _prompt():
    return F.col("role") == "user"


def _label():
    return F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant")


def _turned(spark, sf_dir):
    return S.turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", _prompt())


_TURNED = """
WITH b AS (SELECT *, CASE WHEN role = 'user' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS g FROM conversations),
t AS (SELECT *, CAST(sum(g) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_id FROM b)
"""


def turn_segments(spark, sf_dir):
    return _turned(spark, sf_dir).select("conv_id", "turn", "role", "turn_id")


def turn_text(spark, sf_dir):
    return S.turn_texts(_turned(spark, sf_dir), "conv_id", "turn", _label())


TURN_TEXT_SQL = f"""{_TURNED},
l AS (SELECT *, CASE WHEN trim(coalesce(text, '')) <> '' THEN CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' END END AS label FROM t),
p AS (SELECT *, lag(label) OVER (PARTITION BY conv_id, turn_id ORDER BY turn) AS before FROM l WHERE label IS NOT NULL),
j AS (SELECT conv_id, turn_id, string_agg(CASE WHEN label = 'Assistant' AND before = 'Assistant' THEN trim(text, ' ')
        ELSE label || ': ' || trim(text, ' ') END, chr(10) || chr(10) ORDER BY turn) AS text FROM p GROUP BY ALL),
r AS (SELECT conv_id, turn_id, min(turn) AS seq_start, max(turn) AS seq_end FROM t GROUP BY ALL)
SELECT r.*, coalesce(j.text, '') AS text FROM r LEFT JOIN j USING (conv_id, turn_id)
"""


def turn_anchor(spark, sf_dir):
    """The first assistant text and the first system text of each turn, each on its own."""
    rows = _turned(spark, sf_dir)
    for role in ("assistant", "system"):
        rows = rows.withColumn(role, F.when(F.col("role") == role, F.col("text")))
    return S.anchors(rows, "conv_id", "turn", "assistant", "system")


def closed_turns(spark, sf_dir):
    quiet = F.pmod("conv_id", F.lit(4)) == 0
    found = S.closed(_turned(spark, sf_dir), "conv_id", quiet)
    return found.groupBy("conv_id", "turn_id").agg(F.count("*").alias("n_rows"))


def message_seq(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return S.numbered(rows, "user_id", "ts", "event_id").select("event_id", "user_id", "seq")


def ts_locf(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("ts"))
    return S.carried(rows, "user_id", "event_id", "ts")


def session_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return S.folded(rows, "conv_id", "turn", _prompt(), F.col("role") == "assistant")


def session_facts(spark, sf_dir):
    """Last known value of two facts of a user's events, of which some are missing."""
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("kind"),
        F.when(F.col("event_id") % 7 == 0, F.round("value", 3)).alias("amount"),
    )
    return S.facts(e, "user_id", F.col("event_id"), "kind", "amount")


def session_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    compact = F.when(F.col("role") == "system", F.col("text"))
    plain = F.when(F.col("role") == "assistant", F.col("text"))
    return rows.groupBy("conv_id").agg(S.summary(compact, plain, F.col("turn")).alias("summary"))


QUERIES = {
    f.__name__: f
    for f in (turn_segments, turn_text, turn_anchor, closed_turns, message_seq, ts_locf, session_fold, session_facts, session_summary)
}

ORACLE_SQL = {
    "turn_segments": f"{_TURNED} SELECT conv_id, turn, role, turn_id FROM t",
    "turn_text": TURN_TEXT_SQL,
    "turn_anchor": f"""{_TURNED} SELECT conv_id, turn_id,
        arg_min(CASE WHEN role = 'assistant' THEN text END, turn) FILTER (role = 'assistant') AS assistant,
        arg_min(CASE WHEN role = 'system' THEN text END, turn) FILTER (role = 'system') AS system
        FROM t GROUP BY ALL""",
    "closed_turns": f"""{_TURNED}, m AS (SELECT *, max(turn_id) OVER (PARTITION BY conv_id) AS last FROM t)
        SELECT conv_id, turn_id, count(*) AS n_rows FROM m WHERE turn_id < last OR conv_id % 4 = 0 GROUP BY ALL""",
    "message_seq": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events",
    "ts_locf": """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS ts FROM events)
        SELECT event_id, user_id, coalesce(last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
        first_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS ts FROM e""",
    "session_fold": """SELECT conv_id, count(*) AS n_rows, count(*) FILTER (role = 'user') AS n_prompts, count(*) FILTER (role = 'assistant') AS n_replies,
        arg_min(substr(text, 1, 500), turn) FILTER (role = 'user') AS first_prompt, arg_max(substr(text, 1, 500), turn) FILTER (role = 'user') AS last_prompt,
        arg_max(substr(text, 1, 500), turn) FILTER (role = 'assistant') AS final_reply FROM conversations GROUP BY conv_id""",
    "session_facts": """SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 4 = 0) AS kind,
        arg_max(round(value, 3), event_id) FILTER (event_id % 7 = 0) AS amount FROM events GROUP BY user_id""",
    "session_summary": """SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'system'),
        arg_max(text, turn) FILTER (role = 'assistant')) AS summary FROM conversations GROUP BY conv_id""",
}
