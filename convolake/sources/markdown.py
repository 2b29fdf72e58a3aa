"""Memory files, notes and index files in Markdown.

Front matter is read as ``key: value`` lines with one level of nesting, which
is all that such files hold; whatever can't be read counts as none.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FRONT = re.compile(r"---[ \t]*\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n|$)", re.S)
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
_AFTER = re.compile(r"\**\s*(?:[—–:-]\s*)?")
MEMORY = "name string, description string, type string, body string, has_frontmatter boolean"
NOTE = "title string, surface string, created string, project string, related_sessions array<string>, body string"
LINK = "title string, target string, hook string, raw string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the Markdown files below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))


def _value(text: str):
    bare = text.strip()
    if len(bare) > 1 and bare[0] == bare[-1] and bare[0] in "'\"":
        return bare[1:-1]
    if bare.startswith("[") and bare.endswith("]"):
        return [str(_value(x)) for x in bare[1:-1].split(",") if x.strip()]
    return bare


def front_matter(text: str) -> tuple[dict | None, str]:
    """The front matter, or None, and the body."""
    m = _FRONT.match(text)
    if not m:
        return None, text
    data: dict = {}
    inner = None
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        stripped = line.strip()
        if line[0] in " \t-" and stripped.startswith("- ") and inner is not None:
            data[inner] = [*data[inner], str(_value(stripped[2:]))] if isinstance(data[inner], list) else [str(_value(stripped[2:]))]
            continue
        key, colon, value = stripped.partition(":")
        if not colon or not key:
            return None, text
        if line[0] in " \t":
            if not isinstance(data.get(inner), dict):
                return None, text
            data[inner][key] = _value(value)
        elif value.strip():
            data[key], inner = _value(value), None
        else:
            data[key], inner = {}, key
    return data, text[m.end() :].lstrip("\r\n")


def memory(text: str, fallback: str) -> tuple:
    front, body = front_matter(text)
    if front is None:
        return fallback, "", "", text, False
    meta = front.get("metadata")
    kind = (meta.get("type") if isinstance(meta, dict) else None) or front.get("type") or ""
    flat = lambda v: " ".join(str(v or "").split())
    return str(front.get("name") or fallback), flat(front.get("description")), str(kind), body, True


def note(text: str) -> tuple:
    front, body = front_matter(text)
    front = front or {}
    heading = re.search(r"(?m)^# +(.+)$", body)
    related = front.get("related_sessions")
    listed = [str(x) for x in related] if isinstance(related, list) else [str(related)] if related else []
    title = front.get("title") or (heading[1].strip() if heading else None)
    return title, front.get("surface"), front.get("created"), front.get("project"), listed, body


def link(line: str) -> tuple[str, str, str, str] | None:
    """The first ``[title](file.md)`` of a list item and the hook after it; brackets may nest or be escaped."""
    raw = line.removesuffix("\r")
    item = _ITEM.match(raw)
    if not item:
        return None
    for at in (i for i, c in enumerate(raw) if c == "[" and i >= item.end() - 1):
        depth, i = 0, at
        while i < len(raw):
            depth += {"[": 1, "]": -1}.get(raw[i], 0)
            if not depth:
                break
            i += 2 if raw[i] == "\\" else 1
        target = re.match(r"\]\(([^)\s]*\.md)\)", raw[i:])
        if target and "://" not in target[1]:
            rest = raw[i + target.end() :]
            return re.sub(r"\\([\\\[\]])", r"\1", raw[at + 1 : i]), target[1], rest[_AFTER.match(rest).end() :].strip(), line
    return None


def index_lines(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` without ``text``: a row a link line with ``place``, title, target, hook and the line itself."""

    @F.udf(f"struct<{LINK}>", useArrow=True)
    def parse(line: str):
        return link(line)

    kept = [c for c in found.columns if c != text]
    each = found.select(*kept, F.posexplode(F.split(text, "\n")).alias("place", "_line"))
    return each.withColumn("_l", parse("_line")).filter("_l IS NOT NULL").select(*kept, "place", "_l.*")


def memories(found: DataFrame) -> DataFrame:
    """``files`` as memories, named by their file where they don't say."""

    @F.pandas_udf(MEMORY)
    def parse(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
        columns = [c.split()[0] for c in MEMORY.split(", ")]
        return pd.DataFrame([memory(t or "", n) for t, n in zip(texts, names, strict=True)], columns=columns)

    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    held = found.withColumn("_m", parse("text", stem))
    return held.select("path", stem.alias("stem"), "_m.*", F.sha2("text", 256).alias("sha256"))


def notes(found: DataFrame) -> DataFrame:
    """``files`` as notes."""

    @F.pandas_udf(NOTE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        columns = ["title", "surface", "created", "project", "related_sessions", "body"]
        return pd.DataFrame([note(t or "") for t in texts], columns=columns)

    return found.withColumn("_n", parse("text")).select("path", "_n.*")


def index_line(title: Column, target: Column, hook: Column) -> Column:
    """A canonical link line; brackets that don't balance should be escaped beforehand."""
    flat = F.trim(F.regexp_replace(F.coalesce(hook, F.lit("")), r"\s+", " "))
    head = F.concat(F.lit("- ["), title, F.lit("]("), target, F.lit(")"))
    return F.when(flat == "", head).otherwise(F.concat(head, F.lit(" — "), flat))
