"""Mixing sources to target weights along a curriculum that varies with time.

The run takes as many words as all documents have.  A source's target is its
weight's share of them, at most ``MAX_REPEATS`` times what it has; what a full
source leaves is shared again by weight among the others until none is above.

Over the run, u from 0 to 1, source s is drawn at the rate
``target * (1 + tilt * (1 - 2u))``: sources of less than mean weight come early,
those of more come late, and the rates add up to the whole at any time since
the tilts balance.  The integral, ``target * (u + tilt * (u - u * u))``, is the
words asked of the source so far.  Its documents are laid one after another,
in the order of a hash and as often as the target needs, along that demand; the
inverse of the integral at the place where a document begins is its position
in training, and range-sorting by position gives the training order.

Running sums over a source are taken in two steps, over about sqrt(n) slices of
its hash range and then within each slice, so that a source with a third of all
documents is spread over as many tasks as its size calls for.

``taken`` counts words: the copy at which a target is reached is cut there, so
a source's taken words are its target's whole number.  A null text has size 0,
a null source is a source of its own (last in order), a null doc_id is ordered
like any other; repeated rows are documents of their own, which only differ in
position.  A source without words has target 0.  No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.storage import keep, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: How far a source's rate may stand from its mean rate, of which this is a part below 1.
TILT = 0.8


def sizes(text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_hash() -> Column:
    """A hash of doc_id, text and source; the order within a source."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull(), "source")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n, weight, target, tilt) of (source, source_size, n).

    With sources in ascending order of repeats * size / weight, those up to
    some place are full and the rest share what is left; a source is full if
    its own bound is no more than its share once all before it are full.
    There is one row a source here, never one a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), pick.cast("int")).cast("double"))
    bounded = weighed.withColumn("bound", F.col("source_size").cast("double") * repeats)
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    whole, before = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_ratio.rowsBetween(
        Window.unboundedPreceding, -1
    )
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = bounded.withColumns({"share": left / rest, "at": F.row_number().over(by_ratio)})
    full = F.col("bound") <= F.col("weight") * F.col("share")
    marked = ranked.withColumn("open", F.when(~full, F.col("at")))
    all_rows = Window.partitionBy(F.lit(0)).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min("open").over(all_rows)
    level = F.max(F.when(F.col("at") == first, F.col("share"))).over(all_rows)
    target = F.when(first.isNull() | (F.col("at") < first), F.col("bound")).otherwise(F.col("weight") * level)
    aimed = marked.withColumn("target", target)
    mean = F.sum(F.col("target") * F.col("weight")).over(all_rows) / F.sum("target").over(all_rows)
    off = F.col("weight") - mean
    widest = F.max(F.abs(off)).over(all_rows)
    tilt = F.when(widest > 0, -F.lit(TILT) * off / widest).otherwise(F.lit(0.0))
    return aimed.withColumn("tilt", F.coalesce(tilt, F.lit(0.0))).select("source", "source_size", "n", "weight", "target", "tilt")


def position(asked: Column, target: Column, tilt: Column) -> Column:
    """When, from 0 to 1, ``asked`` words have been drawn from a source."""
    c = F.least(F.lit(1.0), asked / target)
    b = 1 + tilt
    return 2 * c / (b + F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * tilt * c)))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, row_hash, source, size, source_size, weight, target, tilt, first, taken, position) of every row of ``docs``.

    ``first`` is where the document begins in its source, ``position`` when it
    is first drawn, null if it never is.
    """
    rows = keep(docs.select("doc_id", row_hash().alias("h"), "source", sizes().alias("size")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = keep(targets(totals, weights, repeats), "targets").withColumnRenamed("source", "_s")

    slices = F.ceil(F.sqrt("n"))
    unit = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    held = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cut = held.withColumn("slice", F.least(slices - 1, F.floor(unit * slices)).cast("long"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cut.groupBy("source", "slice")
        .agg(F.sum("size").alias("words"))
        .select(F.col("source").alias("_s"), F.col("slice").alias("_k"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("source", "slice").orderBy(F.shiftrightunsigned("h", 11), "h", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = cut.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    laid = local.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_k"))).withColumn(
        "first", F.col("base") + F.col("within")
    )

    asked = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(0).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("size"), asked - passes * F.col("source_size") - F.col("first")))
    taken = F.col("size") * passes + last
    at = F.when(taken > 0, position(F.col("first").cast("double"), F.col("target"), F.col("tilt")))
    return laid.withColumns({"taken": taken.cast("long"), "position": at}).select(
        "doc_id", F.col("h").alias("row_hash"), "source", "size", "source_size", "weight", "target", "tilt", "first", "taken", "position"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words taken of it, in training order."""
    found = mixed(table(spark, sf_dir, "documents"))
    ordered = found.orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc_id"))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


def training_set(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in training order, each as often as the mix takes it.

    A cut copy stays, whole, if at least half of it is taken; a document
    without words stays once.  Rows alike in doc_id, text and source are taken
    alike.
    """
    alike = mixed(docs).groupBy("row_hash").agg(
        F.sum("size").alias("words"),
        F.min("first").alias("first"),
        *[F.first(c).alias(c) for c in ("source_size", "target", "tilt")],
    )
    asked = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size"))).otherwise(0)
    over = 2 * (asked - passes * F.col("source_size") - F.col("first")) >= F.col("words")
    copies = F.when(F.col("words") == 0, 1).otherwise(passes + over.cast("int")).cast("int")
    wanted = alike.withColumn("_copies", copies).filter("_copies > 0").withColumnRenamed("row_hash", "_h")
    plan = keep(wanted.select("_h", "_copies", "first", "source_size", "target", "tilt"), "wanted")
    rows = docs.select(F.struct("*").alias("_row"), row_hash().alias("_h")).join(plan, "_h")
    each = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    begins = (F.col("first") + F.col("_pass") * F.col("source_size")).cast("double")
    at = F.when(F.col("target") > 0, position(begins, F.col("target"), F.col("tilt"))).otherwise(0.0)
    return each.withColumn("_at", at).orderBy("_at", "_h").select("_row.*")
