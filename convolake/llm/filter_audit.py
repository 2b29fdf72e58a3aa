"""What five filters of documents remove, in every order, by a relational word pipeline.

Words are exploded, counted by (document, word) and then by document, which
gives totals and distinct words.  The flags that need no words are outer-joined
to that, and what is left of a document is five failure bits.  32 conditional
counts a part then answer every question about any order of the filters.

A document's failures:

* A: under 100 words
* B: fewer than 80 distinct words for 100 words
* C: more than 10 of 100 characters are A-Z
* D: any of ``#$%&*|``
* E: a smaller doc_id anywhere has the same text

Words are runs of characters other than space and U+0009 to U+000D, compared
as they stand.  A null text is an empty one.  A null doc_id is neither smaller
nor larger than another, so it never fails E; rows of one doc_id don't make
each other fail E.  Repeated rows count as often as they occur.  A null part is
the empty string.  Documents without a label, or with a null one, are neither
good nor toxic; of several labels of one doc_id any 1 counts.  Columns other
than these are ignored, and a table without rows gives none.

Texts are shuffled once, by (doc_id, hash of the text), after repeated rows
have been merged where they lie; both word counts then need no other exchange,
so (document, word) pairs never travel.  Texts of one doc_id with the same
64-bit hash would be taken for one.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.storage import keep, table

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, n_distinct) of every (doc_id, text) with a word; ``docs`` has doc_id, h and text."""
    once = docs.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    words = once.select("doc_id", "h", F.explode(F.split("text", SPACE)).alias("word")).filter("word <> ''")
    by_word = words.groupBy("doc_id", "h", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "h").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): bit k of ``mask`` is set if filter k fails; n rows of the table are alike in all this."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), text.alias("text"))
    named = named.withColumn("h", F.xxhash64("text"))
    flags = named.select(
        "doc_id",
        "h",
        "part",
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > 10 * F.length("text")).alias("c"),
        F.col("text").rlike(r"[#$%&*|]").alias("d"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = keep(flags.groupBy("doc_id", "h", "part", "c", "d", "digest").agg(F.count("*").alias("n")), "flags")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    words = word_counts(named.select("doc_id", "h", "text")).withColumnsRenamed({"doc_id": "w_doc_id", "h": "w_h"})

    joined = rows.join(words, F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("h") == F.col("w_h")), "left")
    joined = joined.join(firsts, "digest", "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    total, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = (total < 100, 100 * distinct < 80 * total, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))
    return joined.select("part", mask.alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "n")


def audit(rows: DataFrame) -> DataFrame:
    """A row for each part, order and step; ``rows`` is what ``failures`` gives."""
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.sum(F.when(which, F.col("n")).otherwise(0)).alias(kind) for kind, which in kinds.items()]
    by_mask = rows.groupBy("part", "mask").agg(*sums)  # 32 rows a part, so that a hot part is no hot task
    counts = [F.sum(F.when(F.col("mask") == m, F.col(kind)).otherwise(0)).alias(f"{kind}_{m}") for kind in kinds for m in range(MASKS)]
    parts = by_mask.groupBy("part").agg(*counts)
    parts = parts.select("part", *[F.array(*[F.col(f"{kind}_{m}") for m in range(MASKS)]).alias(kind) for kind in kinds])

    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = [F.instr("filter_order", letter) for letter in FILTERS]
    one = [F.lit(1 << k) for k in range(len(FILTERS))]
    steps = steps.withColumns(
        {
            "bit": sum((F.when(a == F.col("step"), b).otherwise(0) for a, b in zip(at, one, strict=True)), F.lit(0)),
            "before": sum((F.when(a < F.col("step"), b).otherwise(0) for a, b in zip(at, one, strict=True)), F.lit(0)),
        }
    )

    def total(kind: str, which, weight=lambda m: F.lit(1)) -> Column:
        add = lambda so_far, m: so_far + F.when(which(m), F.get(F.col(kind), m) * weight(m)).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), add)

    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    late = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~late(m)
    each = F.lit(len(ORDERS))
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("all", lambda m: ~fails(m) & ~late(m)).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: fails(m) & late(m)).alias("redundant"),
        total("all", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of k failing filters each is the first in one of k orders
        total("all", fails, lambda m: (each / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes from each language, for every order and step."""
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY text
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), w AS (
  SELECT d.*, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS words, coalesce(d.doc_id > f.first, false) AS e,
         coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM d JOIN firsts f USING (text) LEFT JOIN marks m ON d.doc_id = m.doc_id
), f AS (
  SELECT part, good, toxic,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), e] AS fails
  FROM w
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
), judged AS (
  SELECT s.filter_order, s.step, f.part, f.good, f.toxic,
    fails[ascii(substr(filter_order, step::INT, 1)) - 64] AS now,
    list_bool_or(list_transform(range(1, step), lambda k: fails[ascii(substr(filter_order, k::INT, 1)) - 64])) AS before,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM (SELECT part, good, toxic, fails FROM f) f, steps s
), counted AS (
  SELECT part, filter_order, step,
    count(*) FILTER (NOT now AND NOT coalesce(before, false)) AS kept,
    count(*) FILTER (now AND NOT coalesce(before, false)) AS removed,
    count(*) FILTER (now AND coalesce(before, false)) AS redundant,
    count(*) FILTER (now AND n_fails = 1) AS unique_fails,
    count(*) FILTER (now AND NOT coalesce(before, false) AND good = 1) AS good_lost,
    count(*) FILTER (now AND NOT coalesce(before, false) AND toxic = 1) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step::INT, 1)) AS BIGINT) AS shapley
FROM counted
"""
