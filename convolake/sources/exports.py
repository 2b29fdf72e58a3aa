"""Chat exports: JSON members of zip files to conversations, messages and memories.

Zips are read as binary files; a table function opens each where it lies and
gives its wanted members as JSON texts, which the JVM parses by schema.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMBERS = ("conversations.json", "projects.json", "memories.json")
MEMBER_BYTES = 2 << 30
TOTAL_BYTES = 4 << 30

_BLOCK = "struct<type:string, text:string, name:string>"
_MESSAGE = (
    f"struct<uuid:string, sender:string, text:string, created_at:string, content:array<{_BLOCK}>, "
    "attachments:array<struct<file_name:string>>, files:array<struct<file_name:string>>>"
)
_CONVERSATION = (
    "struct<uuid:string, name:string, summary:string, created_at:string, updated_at:string, project_uuid:string, "
    f"project:struct<uuid:string, name:string>, chat_messages:array<{_MESSAGE}>>"
)
_PROJECT = "struct<uuid:string, name:string, memory:string, updated_at:string>"


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, json, warning): the shallowest wanted members of every zip; too large or broken ones as a warning."""
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in _read(content)], columns=["path", "member", "json", "warning"])

    return zips.select("path", "content").mapInPandas(unzip, "path string, member string, json string, warning string")


def _read(content: bytes) -> Iterator[tuple[str | None, str | None, str | None]]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield None, None, "not a zip file"
        return
    best: dict[str, zipfile.ZipInfo] = {}
    for info in sorted(archive.infolist(), key=lambda i: (i.filename.count("/"), i.filename)):
        best.setdefault(info.filename.rsplit("/", 1)[-1], info)
    left = TOTAL_BYTES
    for member in MEMBERS:
        if member not in best:
            continue
        if best[member].file_size > min(MEMBER_BYTES, left):
            yield member, None, "too large"
            continue
        left -= best[member].file_size
        try:
            yield member, archive.read(best[member]).decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, OSError, RuntimeError) as e:
            yield member, None, f"unreadable: {type(e).__name__}"


def _items(found: DataFrame, member: str, schema: str) -> DataFrame:
    texts = found.filter((F.col("member") == member) & F.col("json").isNotNull())
    return texts.select("path", F.posexplode(F.from_json("json", f"array<{schema}>")).alias("n", "x")).filter("x IS NOT NULL")


def time(text: str | Column) -> Column:
    """An export's time as a UTC timestamp, null if it isn't one."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def conversations(found: DataFrame) -> DataFrame:
    """Conversations with an id and messages, with their project's name: their own, or from the list of projects."""
    c = _items(found, "conversations.json", _CONVERSATION).select("x.*").filter("uuid IS NOT NULL AND uuid <> '' AND size(chat_messages) > 0")
    own = F.coalesce(F.nullif("project_uuid", F.lit("")), F.col("project.uuid"))
    projects = _items(found, "projects.json", _PROJECT).groupBy(F.col("x.uuid").alias("project_id")).agg(F.first("x.name").alias("_listed"))
    named = c.withColumn("project_id", own).join(projects, "project_id", "left")
    return named.withColumn("project_name", F.coalesce(F.col("project.name"), "_listed")).drop("_listed", "project", "project_uuid")


def messages(convs: DataFrame) -> DataFrame:
    """(uuid, seq, message_id, role, text, ts, files): a conversation's messages that say or attach something."""
    m = convs.select("uuid", F.posexplode("chat_messages").alias("n", "m")).filter("m IS NOT NULL")
    block = lambda b: (
        F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool: "), F.coalesce(b["name"], F.lit("?")), F.lit("]")))
    )
    from_blocks = F.array_join(F.filter(F.transform("m.content", block), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    text = F.btrim(F.coalesce(F.nullif(F.col("m.text"), F.lit("")), from_blocks, F.lit("")))
    attached = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<file_name:string>>")), lambda f: f["file_name"])
    files = F.array_distinct(F.filter(F.concat(attached("m.attachments"), attached("m.files")), lambda f: F.coalesce(f, F.lit("")) != ""))
    role = F.when(F.lower("m.sender").isin("human", "user"), "user").otherwise("assistant")
    said = m.select("uuid", "n", F.col("m.uuid").alias("message_id"), role.alias("role"), text.alias("text"), time("m.created_at").alias("ts"), files.alias("files"))
    kept = said.filter((F.col("text") != "") | (F.size("files") > 0))
    seq = F.row_number().over(Window.partitionBy("uuid").orderBy("n")) - 1
    return kept.withColumn("seq", seq.cast("long")).drop("n")


def memories(found: DataFrame) -> DataFrame:
    """(scope, text): an account's memory, each project's, and those on the list of projects; repeats count once."""
    texts = found.filter((F.col("member") == "memories.json") & F.col("json").isNotNull())
    schema = "struct<conversations_memory:string, memory:string, content:string, text:string, project_memories:map<string,string>>"
    whole = F.when(F.ltrim("json").startswith("["), F.from_json("json", f"array<{schema}>")).otherwise(F.array(F.from_json("json", schema)))
    m = texts.select(F.explode(whole).alias("m")).filter("m IS NOT NULL")
    own = F.coalesce("m.conversations_memory", "m.memory", "m.content", "m.text")
    account = m.select(F.lit("account").alias("scope"), own.alias("text"))
    project = m.select(F.explode("m.project_memories").alias("scope", "text"))
    listed = _items(found, "projects.json", _PROJECT).select(F.col("x.uuid").alias("scope"), F.col("x.memory").alias("text"))
    every = account.unionByName(project).unionByName(listed).withColumn("text", F.btrim("text"))
    return every.filter("text IS NOT NULL AND text <> ''").distinct()
