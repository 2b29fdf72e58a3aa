"""Files beside transcripts: what a subagent is, and the whole outputs of tools whose results were cut.

Both are read as texts by Spark and met by name, so nothing is opened by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.functions.redaction import redact

# How tool calls are named, and how a text refers to a saved output.
TOOL_ID = r"^[A-Za-z0-9_-]{1,128}$"
OUTPUT_NAME = r"tool-results/([A-Za-z0-9][A-Za-z0-9._-]*\.(?:txt|json))\b"
META_END = ".meta.json"
VERSION = r"^(.+)~(\d{8}-\d{6})((?:\.[A-Za-z0-9]+)?)$"
#: What a reader is shown, by how much detail it asks for.
DETAIL = {
    "conversation": ("user", "assistant"),
    "tools": ("user", "assistant", "summary", "tool_call", "tool_result"),
    "full": ("user", "assistant", "summary", "tool_call", "tool_result"),
}


def _texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content) of the files below ``root`` whose name is like ``pattern``."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def subagents(spark: SparkSession, root: str) -> DataFrame:
    """(path, agent_type, description) of the transcripts that have a sidecar; null where that can't be read."""
    held = _texts(spark, root, f"*{META_END}").withColumn("rec", F.try_parse_json("content"))
    name = lambda field: F.nullif(F.try_variant_get("rec", f"$.{field}", "string"), F.lit(""))
    path = F.concat(F.expr(f"substr(path, 1, length(path) - {len(META_END)})"), F.lit(".jsonl"))
    return held.select(path.alias("path"), name("agentType").alias("agent_type"), name("description").alias("description"))


def with_subagents(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """``sessions`` (path, …) with agent_type and description, null for those without a sidecar."""
    return sessions.join(found, "path", "left")


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """(base, name, content) of saved outputs; base is the session's folder."""
    held = _texts(spark, root, "*.{txt,json}").withColumn("parts", F.split("path", "/tool-results/"))
    return held.filter("size(parts) = 2").select(F.col("parts")[0].alias("base"), F.col("parts")[1].alias("name"), "content")


def session_folder(path: Column) -> Column:
    """The folder of a transcript's saved outputs: its session's, also for subagents."""
    whole = F.regexp_replace(path, r"\.jsonl$", "")
    return F.when(path.contains("/subagents/"), F.element_at(F.split(path, "/subagents/"), 1)).otherwise(whole)


def full_texts(results: DataFrame, saved: DataFrame, key: str = "message_id") -> DataFrame:
    """``results`` (key, path, tool_use_id, text, …) with ``full_text`` and ``origin``, null where nothing was saved.

    A result's saved output is the file named by its call, as text or JSON,
    else the first file that its text refers to.  It is redacted like any text.
    """
    called = F.when(F.col("tool_use_id").rlike(TOOL_ID), F.array(*[F.concat("tool_use_id", F.lit(end)) for end in (".txt", ".json")]))
    names = F.when(called.isNotNull(), F.array_distinct(F.concat(called, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(OUTPUT_NAME), F.lit(1)))))
    asked = results.select(key, session_folder(F.col("path")).alias("base"), F.posexplode(names).alias("at", "name"))
    met = asked.join(saved, ["base", "name"]).groupBy(key).agg(F.min_by(F.struct("name", "content"), "at").alias("f"))
    told = met.select(key, redact(F.col("f.content")).alias("full_text"), F.concat(F.lit("tool-results file "), F.col("f.name")).alias("origin"))
    return results.join(told, key, "left")


def detailed(messages: DataFrame, detail: str) -> DataFrame:
    """The ``messages`` that a reader is shown."""
    if detail not in DETAIL:
        raise ValueError(f"detail must be one of {', '.join(DETAIL)}")
    return messages.filter(F.col("role").isin(*DETAIL[detail]))


def session_kinds(sessions: DataFrame, automated: list[str], interactive: list[str]) -> tuple[DataFrame, DataFrame]:
    """``sessions`` with ``kind`` by their entrypoint, and drift counters (category, value, n) of entrypoints that nobody knows."""
    kind = F.when(F.col("entrypoint").isin(automated), "automated").otherwise("interactive")
    unknown = sessions.filter((F.col("entrypoint") != "") & ~F.col("entrypoint").isin([*automated, *interactive]))
    counts = unknown.groupBy(F.col("entrypoint").alias("value")).agg(F.count("*").alias("n"))
    return sessions.withColumn("kind", kind), counts.select(F.lit("entrypoint").alias("category"), "value", "n")


def versions(files: DataFrame) -> DataFrame:
    """(path, at, version) of the newest kept version of each file; ``files`` has the paths of versions, ``<stem>~<time><ext>``."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    part = lambda k: F.regexp_extract(name, VERSION, k)
    named = files.filter(name.rlike(VERSION)).select(F.concat(folder, part(1), part(3)).alias("to"), part(2).alias("at"), F.col("path").alias("version"))
    newest = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("at"), "version"))
    return named.withColumn("_n", newest).filter("_n = 1").select(F.col("to").alias("path"), "at", "version")
