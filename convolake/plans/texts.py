"""Text, redaction and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.functions import redaction
from convolake.functions import text as T
from convolake.operators import chunking
from convolake.sources import transcripts
from convolake.storage import table


def one_line_cell(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.one_line(F.col("text"), 80).alias("line"), T.cell(F.col("text"), 60).alias("cell"))


def size_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.size_label(F.col("n_chars")).alias("label"))


def duration_label(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.duration_label(F.col("event_id") * 37).alias("label"))


def slugify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.slug(F.col("text")).alias("slug"), F.md5(T.folded(F.col("text"))).alias("folded"))


def sha256_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.prop("props", "k").alias("k"), T.prop("props", "missing", "string").alias("missing"))


def time_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    later = F.col("ts") + F.expr("make_interval(0, 0, 0, 0, cast(event_id % 48 as int))")
    return e.select("event_id", T.iso(F.col("ts")).alias("iso"), T.epoch(F.col("ts")).alias("epoch"), T.span(F.col("ts"), later).alias("span"))


def parsed_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", T.epoch(T.parsed(raw)).alias("epoch"))


def text_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("bits"))


def clipped_args(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clipped(F.col("text")).alias("text"))


def redact_tokens(spark, sf_dir):
    """The passes that DuckDB's patterns can express, too."""
    docs = table(spark, sf_dir, "documents")
    plain = F.concat(F.lit("ghp_"), F.sha2("text", 256), F.lit(" AIza"), F.sha2("text", 256), F.lit(" "), F.col("text"))
    return docs.select("doc_id", F.md5(redaction.redact_tokens(plain)).alias("digest"))


def redact_counts_by_kind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", redaction.redact(F.col("text")).alias("t"))
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(r"\[REDACTED:(\w+)\]"), 1)).alias("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def split_chunks(spark, sf_dir):
    found = chunking.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.col("i").cast("long").alias("i"), F.length("piece").cast("long").alias("n"), F.md5("piece").alias("digest"))


def markdown_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n# ").alias("text"))
    found = chunking.pieces(docs, "text", chunking.sections)
    return found.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("piece").alias("digest"))


def hash_embed(spark, sf_dir):
    found = chunking.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.slice("embedding", 1, 8).alias("head"))


#: What is put behind a page's path, and what the file is then.
_FILES = {
    "/s.jsonl": "transcript", "/subagents/agent-1.jsonl": "subagent", "/memory/fact.md": "memory", "/memory/MEMORY.md": "memory_index",
    "/memory/archive/old.md": "memory_archived", "/memory/MEMORY.sync-conflict-1.md": "conflict", "/notes/n.md": "note", "/.hidden.jsonl": None,
    "/tool-results/t.jsonl": None, "/.stversions/s.jsonl": None, "/readme.txt": None,
}


def path_kinds(spark, sf_dir):
    """What files below the paths of pages hold."""
    end = F.get(F.array(*map(F.lit, _FILES)), F.pmod("page_id", F.lit(len(_FILES))).cast("int"))
    path = F.concat(F.regexp_extract("url", "://([^?#]*)", 1), end)
    return table(spark, sf_dir, "pages").select("page_id", transcripts.classified(path).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        one_line_cell, size_label, duration_label, slugify, sha256_text, json_props, time_labels, parsed_times, text_entropy,
        clipped_args, redact_tokens, redact_counts_by_kind, split_chunks, markdown_sections, hash_embed, path_kinds,
    )
}

_LINE = r"trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g'))"
ORACLE_SQL = {
    "one_line_cell": f"""WITH l AS (SELECT doc_id, {_LINE} AS s FROM documents),
        c AS (SELECT doc_id, s, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 59)) || '…' END AS c FROM l)
        SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 79)) || '…' END AS line,
        coalesce(nullif(replace(c, '|', '\\|'), ''), '–') AS cell FROM c""",
    "size_label": """WITH t AS (SELECT doc_id, n_chars, CAST(round(n_chars / 100.0) AS BIGINT) AS t FROM documents)
        SELECT doc_id, CASE WHEN n_chars < 1000 THEN n_chars || ' chars' ELSE (t // 10) || '.' || (t % 10) || 'k chars' END AS label FROM t""",
    "duration_label": """WITH d AS (SELECT event_id, event_id * 37 AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm'
        WHEN s < 86400 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 86400 || 'd ' || s % 86400 // 3600 || 'h' END AS label FROM d""",
    "slugify": """SELECT doc_id, rtrim(substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-') AS slug,
        md5(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) AS folded FROM documents""",
    "sha256_text": "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    "time_labels": """WITH e AS (SELECT event_id, ts, ts + to_hours(event_id % 48) AS b FROM events) SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
        CAST(floor(epoch(ts)) AS BIGINT) AS epoch, CASE WHEN strftime(ts, '%Y-%m-%d %H:%M') = strftime(b, '%Y-%m-%d %H:%M') THEN strftime(ts, '%Y-%m-%d %H:%M')
        ELSE strftime(ts, '%Y-%m-%d %H:%M') || ' → ' || CASE WHEN ts::DATE = b::DATE THEN strftime(b, '%H:%M') ELSE strftime(b, '%Y-%m-%d %H:%M') END END AS span FROM e""",
    "parsed_times": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS epoch FROM events",
    "text_entropy": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS k FROM c WHERE c <> '' GROUP BY ALL),
        s AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(sum(-p * log2(p)), 6) AS bits FROM s GROUP BY doc_id""",
    "clipped_args": "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 499) || '…' ELSE text END AS text FROM documents",
    "redact_tokens": r"""WITH d AS (SELECT doc_id, 'ghp_' || sha256(text) || ' AIza' || sha256(text) || ' ' || text AS t FROM documents)
        SELECT doc_id, md5(regexp_replace(regexp_replace(t, 'gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}', '[REDACTED:github_token]', 'g'),
        'AIza[A-Za-z0-9_-]{30,}', '[REDACTED:google_api_key]', 'g')) AS digest FROM d""",
    "path_kinds": "SELECT page_id, CASE page_id % 11 "
    + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(_FILES.values()) if kind)
    + " END AS kind FROM pages",
}
