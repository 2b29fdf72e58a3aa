"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document.  The ledger keeps the
measurements and one failure bit per rule; a policy is a versioned set of
rules, so choosing another policy, or asking what each rule costs, reads the
ledger and never the texts.

Words are runs of characters other than space and U+0009 to U+000D.  A null
text has no words and so fails ``few_words``; so does an empty one.  Repeated
rows are judged each on its own; a null doc_id stays null; columns besides
doc_id and text are ignored.

Nothing is shuffled: a document's windows are hashed within its row, and only
where two hashes agree are the windows themselves sorted and compared, so the
cost for a very long text is n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.storage import table

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Bit of each rule, and when a document fails it.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 10"),
    "repeated_windows": (1, "100 * n_repeat_words > 20 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "10 * n_dup_lines > 3 * n_lines"),
    "word_length": (4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "upper_case": (5, "2 * n_upper > word_chars"),
}
BASE = ("few_words", "repeated_windows")

#: Versions of the policy; a later one never changes an earlier one.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines", "word_length", "upper_case"),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words of a text in windows that the text holds twice or more."""

    def exact(w: Column, starts: Column) -> Column:
        spelt = F.transform(
            starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("t"), i.alias("i"))
        )

        def places(s: Column) -> Column:
            twin = lambda k, other: F.coalesce(F.get(s, k)["t"] == F.get(s, other)["t"], F.lit(False))
            ranks = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: twin(k, k - 1) | twin(k, k + 1))
            return F.sort_array(F.transform(ranks, lambda k: F.get(s, k)["i"]))

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

        return _let(F.sort_array(spelt), lambda s: _let(places(s), covered))

    def measured(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(w, starts)))

    return F.coalesce(F.when(F.size(words) > WINDOW, _let(words, measured)), F.lit(0)).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements that the rules use, as long columns in place of columns of these names."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    own = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    t, w, ln = own + "t", own + "w", own + "l"
    held = docs.withColumns({t: whole, w: words, ln: lines})
    return held.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size(ln).cast("long"),
            "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_repeat_words": _repeat_words(F.col(w)),
        }
    ).drop(t, w, ln)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``: bit k is set if the rule of bit k fails."""
    bits = F.lit(0).cast("long")
    for bit, fails in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def mask(policy: str = CURRENT) -> int:
    """The rules of a policy as a bitmask."""
    return sum(1 << RULES[name][0] for name in POLICIES[policy])


def verdict(policy: str = CURRENT) -> Column:
    """Whether a row of a ledger passes ``policy``."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What each rule of ``policy`` does: documents it fails, and documents that it alone rejects.

    Rows of the ledger are first counted by their bits, so at most 2 to the
    number of rules rows are left for the rest.
    """
    combos = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("docs"))
    names = [F.struct(F.lit(name).alias("rule"), F.lit(1 << RULES[name][0]).cast("long").alias("bit")) for name in POLICIES[policy]]
    each = combos.select("bits", "docs", F.explode(F.array(*names)).alias("r"))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("docs")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("docs")).otherwise(0)).alias(
            "kept_without"
        ),
    )


def passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass ``policy``."""
    judged = ledger(docs.select(F.struct("*").alias("_row"), "text"))
    return judged.filter(verdict(policy)).select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdict of every document."""
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(sum(1 << RULES[name][0] for name in BASE))) != 0
    return rows.select("doc_id", *MEASURES, base.alias("base_failed"), (~base & verdict()).alias("kept"), "fail_bits")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT r, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3),
         lambda i: array_to_string(words[i:i + 4], ' '))) AS t
  FROM w WHERE len(words) > 5
), twice AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, sum(least(5, coalesce(after - i, 5))) AS n FROM twice GROUP BY r
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(length(regexp_replace(text, '\P{Lu}', '', 'g')) AS BIGINT) AS n_upper,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
    + 32 * (2 * n_upper > word_chars)::INT AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""
