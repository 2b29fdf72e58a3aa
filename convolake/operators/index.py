"""A keyword index as tables, and ranked search that reads nothing else.

An index is three tables in a folder: ``postings`` (bucket, term, form, docs,
positions), blocks of documents with a form's places in each, dealt by a hash of the term and sorted by it, so that a query opens
the buckets of its terms and skips the row groups of others; ``lengths``
(doc_id, dl); and ``totals`` (n, avgdl), one row.  Forms are folded words,
terms their stems (``functions.stem``).  Statistics are of the whole index,
before any filter.

Words are located where the documents lie, so that only blocks of postings are
shuffled and sorted, once: neither single words nor single postings.

A null text has no words, but counts as a document; documents are told apart
by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.functions import stem
from convolake.operators import retrieval as R

BUCKETS = 32
#: Tasks that write a bucket, so that a term in every document isn't one task's work.
SPREAD = 4
#: Words that a worker locates at a time.
WORDS = 1 << 20
K1, B, MIN_IDF = R.K1, R.B, R.MIN_IDF
#: Folded words by the query word, in lower case, that they are to match.
Forms = dict[str, tuple[str, ...]]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _located(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(term, form, docs, positions) of a batch of (doc_id, words): a row a form, with its places by document."""
    held = batch.column("words")
    sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    spelt = held.flatten().dictionary_encode()
    forms: dict[str, int] = {}
    form_of = np.array([forms.setdefault(stem.folded(w), len(forms)) for w in spelt.dictionary.to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pair = form_of[spelt.indices.to_numpy()] * len(sizes) + doc
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))  # of a form in a document
    outer = np.searchsorted(pair[first] // len(sizes), np.arange(len(forms) + 1))
    ends = pa.array(outer.astype(np.int32))
    inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(pair)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    columns = {
        "term": pa.array(map(stem.term, forms), pa.string()),
        "form": pa.array(forms, pa.string()),
        "docs": pa.ListArray.from_arrays(ends, batch.column("doc_id").take(pa.array(doc[order][first]))),
        "positions": pa.ListArray.from_arrays(ends, inner),
    }
    return pa.RecordBatch.from_pydict(columns)


def postings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(term, form, docs, positions) of every form of a term, found where the documents lie, in blocks of about ``WORDS`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(words):  # whole documents of about WORDS words
                done = words[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(words, done + WORDS, "right")))
                yield _located(batch.slice(at, end - at))
                at = end

    each = docs.select(F.col(doc_id).alias("doc_id"), stem.words(text).alias("words"))
    kind = each.schema["doc_id"].dataType.simpleString()
    return each.mapInArrow(run, f"term string, form string, docs array<{kind}>, positions array<array<int>>")


def build(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the index of ``docs`` below ``path``."""
    found = postings(docs, text, doc_id).withColumn("bucket", _bucket(F.col("term")))
    salt = F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(SPREAD))
    dealt = found.repartition("bucket", salt).sortWithinPartitions("bucket", "term", "form")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    lengths = docs.select(F.col(doc_id).alias("doc_id"), F.size(stem.words(text)).alias("dl"))
    lengths.write.parquet(f"{path}/lengths")
    stats = docs.sparkSession.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    stats.coalesce(1).write.parquet(f"{path}/totals")


def _opened(blocks: DataFrame) -> DataFrame:
    """(doc_id, positions) of blocks of postings."""
    return blocks.select(F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), "positions"))).toDF("doc_id", "positions")


class Index:
    """An index as written by ``build``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.lengths, self.totals = spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/totals")
        schema = f"term string, form string, docs array<{self.lengths.schema['doc_id'].dataType.simpleString()}>, positions array<array<int>>, bucket int"
        self.postings = spark.read.schema(schema).parquet(f"{path}/postings")  # an index without terms has no files to tell

    def entries(self, word: str, prefix: bool = False, forms: Forms | None = None) -> DataFrame:
        """(doc_id, positions) of a word as it is typed, or of the terms that its stem begins; a row a form and document.

        Of a word that ``forms`` lists, only these forms count.
        """
        term = stem.term(word)
        if prefix:
            return _opened(self.postings.filter(F.col("term").startswith(term)))
        here = (F.col("bucket") == _bucket(F.lit(term))) & (F.col("term") == term)
        if forms and word in forms:
            here &= F.col("form").isin(*forms[word])
        return _opened(self.postings.filter(here))

    def occurrences(self, phrase: R.Phrase, forms: Forms | None = None) -> DataFrame:
        """(doc_id, f): how often the phrase occurs in each document that has it, in one row or in a row a form."""
        parts = [self.entries(w, phrase.prefix and k == len(phrase.words) - 1, forms) for k, w in enumerate(phrase.words)]
        if len(parts) == 1:
            return parts[0].select("doc_id", F.size("positions").alias("f"))
        whole = [p.groupBy("doc_id").agg(F.flatten(F.collect_list("positions")).alias("positions")) for p in parts]
        found = whole[0].withColumnRenamed("positions", "starts")
        for k, part in enumerate(whole[1:], 1):
            both = F.array_intersect("starts", F.expr(f"transform(positions, p -> p - {k})"))
            found = found.join(part, "doc_id").select("doc_id", both.alias("starts")).filter("size(starts) > 0")
        return found.select("doc_id", F.size("starts").alias("f"))

    def search(self, query: str, forms: Forms | None = None) -> DataFrame:
        """(doc_id, score) of the documents that match, by BM25.

        A phrase adds to a document's score where all that it is part of
        matches: in ``a b OR c`` a document with a and c, but without b, is scored by c alone.
        A query word matches all that has its stem, or the ``forms`` listed for it alone.
        """
        node = R.parse(query)
        every = list(dict.fromkeys(_leaves(node)))
        hits = reduce(DataFrame.unionByName, [self.occurrences(p, forms).withColumn("i", F.lit(i)) for i, p in enumerate(every)])
        counts = [F.coalesce(F.sum(F.when(F.col("i") == i, F.col("f"))), F.lit(0)).alias(f"f{i}") for i in range(len(every))]
        per_doc = hits.groupBy("doc_id").agg(*counts)
        stats = per_doc.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(every))]).crossJoin(self.totals)  # one row each
        has = {p: F.col(f"f{i}") > 0 for i, p in enumerate(every)}
        both = per_doc.filter(_matches(node, has)).join(self.lengths, "doc_id").crossJoin(F.broadcast(stats))

        def part(phrase: R.Phrase, counts: Column) -> Column:
            i = every.index(phrase)
            df, f = F.col(f"df{i}"), F.when(counts, F.col(f"f{i}")).otherwise(0)
            idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
            norm = f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
            return F.when(idf > 0, idf).otherwise(MIN_IDF) * f * (K1 + 1) / norm

        score = reduce(lambda a, b: a + b, [part(*x) for x in _scored(node, has, F.lit(True))])
        return both.select("doc_id", score.alias("score"))


def _scored(node: R.Node, has: dict[R.Phrase, Column], within: Column) -> list[tuple[R.Phrase, Column]]:
    """The phrases that add to a score, and where they do."""
    if node[0] == "phrase":
        return [(node[1], within)]
    within = within if node[0] == "or" else within & _matches(node, has)
    return _scored(node[1], has, within) + ([] if node[0] == "not" else _scored(node[2], has, within))


def _leaves(node: R.Node) -> list[R.Phrase]:
    return [node[1]] if node[0] == "phrase" else _leaves(node[1]) + _leaves(node[2])


def _matches(node: R.Node, has: dict[R.Phrase, Column]) -> Column:
    if node[0] == "phrase":
        return has[node[1]]
    left, right = _matches(node[1], has), _matches(node[2], has)
    return {"and": left & right, "or": left | right, "not": left & ~right}[node[0]]
