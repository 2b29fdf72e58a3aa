"""Queries of names, sizes, networks, rates and transcripts of several parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import surface as X
from convolake.storage import table

NETWORKS = ["10.0.0.0/8", "192.168.4.0/22"]


def _ip():
    return F.concat_ws(".", F.when(F.col("event_id") % 2 == 0, "10").otherwise("192"), F.lit("168"), *[F.pmod(F.col("user_id") * k, F.lit(256)).cast("string") for k in (1, 7)])


def name_validation(spark, sf_dir):
    """How many of a text's words may be names of files."""
    words = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(words, X.valid_name)).alias("valid"))


def size_warnings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.size_warning(F.col("text")).alias("warning"))
    return docs.filter("warning IS NOT NULL")


def network_membership(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.within(_ip(), NETWORKS).alias("inside"))


def rate_limited(spark, sf_dir):
    """Calls let through at 3 a day and user, where only those let through count."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return X.admitted(e, "user_id", "ts", "event_id", 3, 86_400).select("event_id", "admitted")


def session_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parent = F.when(F.col("conv_id") % 5 > 0, F.col("conv_id") - F.col("conv_id") % 5)
    sessions = rows.groupBy("conv_id").agg(F.min("turn").alias("started_at")).withColumn("parent", parent)
    return X.joined_parts(rows, sessions, "conv_id", "parent", "turn")


def message_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.text_page(F.col("text"), 100, 400).alias("page"))


def note_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("name"))
    return X.numbered_names(docs, "name", "doc_id").select("doc_id", "unique_name")


def keyword_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.highlighted(F.col("text"), ["licensed", "under"], 120).alias("snippet"))


QUERIES = {
    f.__name__: f
    for f in (name_validation, size_warnings, network_membership, rate_limited, session_blocks, message_page, note_names, keyword_snippets)
}

ORACLE_SQL = {
    "name_validation": """SELECT doc_id, CAST(len(list_filter(string_split(lower(text), ' '), lambda w: regexp_matches(w, '^[a-z0-9][a-z0-9_-]{0,63}$'))) AS INT) AS valid
        FROM documents""",
    "size_warnings": """SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 200 THEN len(string_split(text, chr(10))) || ' lines, 200 are read'
        ELSE strlen(text) || ' bytes, 25000 are read' END AS warning FROM documents WHERE len(string_split(text, chr(10))) > 200 OR strlen(text) > 25000""",
    "network_membership": """SELECT event_id, event_id % 2 = 0 OR (user_id % 256) BETWEEN 4 AND 7 AS inside FROM events""",
    "session_blocks": """WITH s AS (SELECT conv_id, min(turn) AS st, CASE WHEN conv_id % 5 > 0 THEN conv_id - conv_id % 5 END AS parent FROM conversations GROUP BY conv_id),
        p AS (SELECT conv_id, coalesce(parent, conv_id) AS root, CASE WHEN parent IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY parent ORDER BY st, conv_id) END AS part FROM s)
        SELECT root, part, conv_id, turn, role FROM conversations JOIN p USING (conv_id)""",
    "message_page": """WITH c AS (SELECT doc_id, text, substr(text, 101, 400) AS c FROM documents), n AS (SELECT *, length(c) - length(string_split(c, chr(10))[-1]) AS w FROM c)
        SELECT doc_id, CASE WHEN length(text) <= 500 OR w = 0 THEN c ELSE substr(c, 1, w) END AS page FROM n""",
    "note_names": """WITH n AS (SELECT doc_id, lang || '-' || source AS name, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)
        SELECT doc_id, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS unique_name FROM n""",
}
