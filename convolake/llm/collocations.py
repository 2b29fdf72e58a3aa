"""Phrase collocations of two and three words, by a minimal perfect hash over Apriori-safe candidates.

A text, A-Z as a-z, is cut into pieces at ``.,;:!?`` and U+000A to U+000D, and
those into words at spaces and tabs.  Everything is counted per language, a
null one being ``und``.  n counts all words and f(phrase) all places of a
phrase within pieces, overlaps included.  A phrase with a = f >= ``LEAST`` is a
candidate; cut after its first k words it has l and r, how often its parts
occur, and the score floor(1000000 * a * a / (l * r)); the cut of the lowest
score counts, of equal ones the first.  A candidate inside a longer one that
occurs at least half as often is dropped.

Words, pairs and triples are counted one after the other:

1. Mappers hash the phrases of their documents, leaving out those with a part
   that isn't frequent, as far as a Bloom filter of bounded size knows: a
   phrase is no more frequent than its parts.  Counts by key are written in
   blocks by shard, a range of keys.
2. In each shard a bincount of hashed keys leaves out what can't reach ``LEAST``
   (it may only keep too much), and the rest, which are the candidates, get a
   minimal perfect hash with their keys stored.
3. Mappers of a few branches a shard look up the slots of their blocks' keys,
   verify them by the stored keys and bincount into arrays of one number a
   slot; a shard's arrays are summed up the tree.

The phrases of frequent keys are then spelt, first from a few documents, in
which the most frequent ones occur, then from more, and what is left from all,
so that a phrase is told a few times and not by every task.  The counts of a
phrase and of the parts of its cuts are read from the arrays by slot.  So no
task or driver holds all candidates, and nothing but filters of at most 32 MB
is broadcast.

Keys have 64 bits; of n phrases two share one with a probability of n * n /
4e19, and where two spellings of one key come up the job fails.  Null texts are
empty, repeated rows count as often as they occur, columns other than text and
lang are ignored, and a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.llm import bloom, words
from convolake.llm.perfect import PerfectHash
from convolake.storage import keep, table

LEAST = 10
MOST_WORDS = 3
TOP = 2000
SCALE = 1_000_000
#: A candidate goes if a longer one that holds it has this share of its count, in hundredths.
SHARE = 50
#: Phrases that a mapper holds before it counts them, and arrays that are summed to a shard's one.
FLUSH = 1 << 21
BRANCHES = 4
#: Numbers of the bincount that leaves out rare keys, for each key of the shard.
SKETCH_ROOM = 4
#: Parts in which a language's candidates are ranked before they are ranked together.
SALTS = 64
SEEN = 500_000
#: Phrases are spelt from one in so many documents, by a hash of their texts; at last from all.
SPELL = (64, 8, 1)
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_WORD = words.flags(_SEPARATORS + b" \t")
_SEPARATE = ~words.flags(_SEPARATORS)
_FACTORS = np.random.default_rng(53).integers(1, 1 << 63, (MOST_WORDS, 2), dtype=np.uint64) | np.uint64(1)


def _grams(texts: list[bytes], langs: list[str]) -> tuple[words.Words, list[np.ndarray]]:
    """The words of texts, and for 1, 2 and 3 words the key of the phrase at each place; 0 where none is."""
    w = words.found(texts, _WORD)
    salts = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)
    one = words.mixed(w.hashes ^ salts[w.doc]) | np.uint64(1)
    ends = np.concatenate([[0], np.cumsum(_SEPARATE[w.data])])
    together = ends[w.starts[1:]] == ends[w.ends[:-1]]  # a newline stands between texts
    grams = [one]
    for k in range(1, MOST_WORDS):
        short = grams[-1]
        longer = np.zeros(len(one), np.uint64)
        at = np.flatnonzero((short[: len(one) - k] != 0) & together[k - 1 :]) if len(one) > k else np.empty(0, np.int64)
        longer[at] = words.mixed(short[at] * _FACTORS[k, 0] + one[at + k] * _FACTORS[k, 1]) | np.uint64(1)
        grams.append(longer)
    return w, grams


def _safe(grams: list[np.ndarray], size: int, frequent: bytes | None) -> np.ndarray:
    """Places of phrases of ``size`` words whose parts, one word shorter, may all be frequent."""
    at = np.flatnonzero(grams[size - 1])
    if frequent is None:
        return at
    at = at[bloom.may_hold(frequent, grams[size - 2][at])]
    return at[bloom.may_hold(frequent, grams[size - 2][at + 1])]


def _each(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    langs = batch.column("lang").to_pylist()
    for first, texts in words.slices(batch.column("text")):
        yield texts, langs[first : first + len(texts)]


def _blocks(docs: DataFrame, size: int, shards: int, frequent: bytes | None) -> DataFrame:
    """(shard, branch, keys, counts) of phrases of ``size`` words; with ``size`` 1 also (lang, n) of all words."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64())
    columns = ["shard", "branch", "keys", "counts", "lang", "n"]
    bounds = np.array([k << 64 - shards.bit_length() + 1 for k in range(1, shards)], np.uint64)

    def of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    def counted(parts: list[np.ndarray], branch: int) -> pa.RecordBatch:
        x = np.sort(np.concatenate(parts))
        firsts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
        keys, counts = x[firsts], np.diff(np.append(firsts, len(x)))
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return of([(k, branch, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes(), None, None) for k, a, b in spans])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch, parts, waiting, totals = TaskContext.get().partitionId(), [], 0, {}
        for batch in batches:
            for texts, langs in _each(batch):
                w, grams = _grams(texts, langs)
                if size == 1:
                    for lang, n in zip(langs, np.bincount(w.doc, minlength=len(texts)).tolist(), strict=True):
                        totals[lang] = totals.get(lang, 0) + n
                found = grams[size - 1][_safe(grams, size, held.value)]
                parts.append(found)
                waiting += len(found)
                if waiting >= FLUSH:
                    yield counted(parts, branch % BRANCHES)
                    branch, parts, waiting = branch + 1, [], 0
            if len(totals) > SEEN:
                yield of([(None, None, None, None, *x) for x in totals.items()])
                totals = {}
        if waiting:
            yield counted(parts, branch % BRANCHES)
        yield of([(None, None, None, None, *x) for x in totals.items()])

    return docs.mapInArrow(run, "shard int, branch int, keys binary, counts binary, lang string, n long")


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in column])


def _hashed(blocks: pa.Table) -> pa.Table:
    """(shard, hash): the minimal perfect hash of the keys of a shard that may be frequent."""
    keys, counts = _joined(blocks["keys"], "<u8"), _joined(blocks["counts"], "<u4")
    room = 1 << (SKETCH_ROOM * len(keys)).bit_length()
    at = (words.mixed(keys) & np.uint64(room - 1)).astype(np.int64)
    likely = np.bincount(at, weights=counts, minlength=room)[at] >= LEAST
    made = PerfectHash.of(np.unique(keys[likely])).pack()
    return pa.table({"shard": blocks["shard"].slice(0, 1), "hash": pa.array([made], pa.binary())})


def _summed(blocks: pa.Table, hashes: pa.Table) -> pa.Table:
    """(shard, sums): one number a slot, of the blocks of a branch."""
    if not len(hashes) or not len(blocks):
        return pa.table({"shard": pa.array([], pa.int32()), "sums": pa.array([], pa.binary())})
    held = PerfectHash.unpack(hashes["hash"][0].as_py())
    keys, counts = _joined(blocks["keys"], "<u8"), _joined(blocks["counts"], "<u4")
    slots = held.slots(keys)
    good = slots >= 0
    sums = np.bincount(slots[good], weights=counts[good], minlength=len(held.keys)).astype("<i8")
    return pa.table({"shard": blocks["shard"].slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})


def _tree(sums: pa.Table) -> pa.Table:
    """A shard's arrays as one."""
    total = np.sum([np.frombuffer(x.as_py(), "<i8") for x in sums["sums"]], axis=0, dtype=np.int64)
    return pa.table({"shard": sums["shard"].slice(0, 1), "sums": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def counted(blocks: DataFrame, size: int) -> DataFrame:
    """(size, shard, hash, sums): the candidates of each shard and how often each occurs, by slot."""
    some = blocks.filter("shard IS NOT NULL").select("shard", "branch", "keys", "counts")
    hashes = keep(some.select("shard", "keys", "counts").groupBy("shard").applyInArrow(_hashed, "shard int, hash binary"), "hashes")
    branches = hashes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("branch"), "hash")
    both = some.groupBy("shard", "branch").cogroup(branches.groupBy("shard", "branch"))
    sums = both.applyInArrow(_summed, "shard int, sums binary").groupBy("shard").applyInArrow(_tree, "shard int, sums binary")
    return keep(hashes.join(sums, "shard").select(F.lit(size).alias("size"), "shard", "hash", "sums"), "counts")


def _frequent(counts: DataFrame) -> DataFrame:
    """(size, key) of the phrases with ``LEAST`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, made, sums in zip(*(batch.column(c) for c in ("size", "hash", "sums")), strict=True):
                good = np.frombuffer(sums.as_py(), "<i8") >= LEAST
                keys = PerfectHash.unpack(made.as_py()).keys[good].view(np.int64)
                sizes = np.full(len(keys), size.as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(keys)], names=["size", "key"])

    return counts.select("size", "hash", "sums").mapInArrow(run, "size int, key long")


def _spelt(docs: DataFrame, frequent: dict[int, bytes]) -> DataFrame:
    """(key, lang, phrase) of the phrases that may be frequent."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {size: np.empty(0, np.uint64) for size in held.value}
        for batch in batches:
            for texts, langs in _each(batch):  # a slice's phrases go at once, so that no batch holds all of its own
                w, grams = _grams(texts, langs)
                found, phrases, of = [], [], []
                for size, filter_ in held.value.items():
                    keys, at = np.unique(grams[size - 1], return_index=True)
                    good = (keys != 0) & bloom.may_hold(filter_, keys)
                    good[good] = ~np.isin(keys[good], seen[size], assume_unique=True)
                    seen[size] = np.union1d(seen[size], keys[good]) if len(seen[size]) < SEEN else keys[good]
                    for i in at[good].tolist():
                        spans = zip(w.starts[i : i + size].tolist(), w.ends[i : i + size].tolist(), strict=True)
                        phrases.append(b" ".join([w.data[a:b].tobytes() for a, b in spans]).decode("utf-8", "replace"))
                        of.append(langs[w.doc[i]])
                    found.append(keys[good].view(np.int64))
                arrays = [pa.array(np.concatenate(found)), pa.array(of, pa.string()), pa.array(phrases, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "lang", "phrase"])

    return docs.mapInArrow(run, "key long, lang string, phrase string").distinct()


def _phrases(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, lang, phrase) of all frequent phrases, and some others that share a filter's bits with them."""
    left = keep(_frequent(counts), "frequent")
    parts = docs.rdd.getNumPartitions()
    told = None
    for one_in in SPELL:
        some = docs if one_in == 1 else docs.filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).coalesce(max(1, parts // one_in))
        filters = {size: bloom.held(left.filter(F.col("size") == size), "key") for size in range(2, MOST_WORDS + 1)}
        found = keep(_spelt(some, filters), "phrases")
        told = found if told is None else told.unionByName(found)
        left = keep(left.join(found.select("key"), "key", "left_anti").select("size", "key"), "left")
    return told.distinct()  # what only shares bits may be told twice


def _parted(phrases: DataFrame) -> DataFrame:
    """``phrases`` (key, lang, phrase) with their number of words and the keys of l and r for each cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, grams = _grams([x.encode() for x in batch.column("phrase").to_pylist()], batch.column("lang").to_pylist())
            sizes = np.bincount(w.doc, minlength=batch.num_rows)
            firsts, signed = (np.cumsum(sizes) - sizes).tolist(), [x.view(np.int64) for x in grams]
            parts = [
                [int(x) for k in range(1, n) for x in (signed[k - 1][i], signed[n - k - 1][i + k])]
                for i, n in zip(firsts, sizes.tolist(), strict=True)
            ]
            arrays = [pa.array(sizes.astype(np.int32)), *batch.columns, pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["size", "key", "lang", "phrase", "parts"])

    return phrases.mapInArrow(run, "size int, key long, lang string, phrase string, parts array<long>")


def _read(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(size, key, f) of the ``wanted`` (size, shard, key), read by slot; 0 for what is no candidate."""

    def run(keys: pa.Table, counts: pa.Table) -> pa.Table:
        f = np.zeros(len(keys), np.int64)
        if len(counts) and len(keys):
            slots = PerfectHash.unpack(counts["hash"][0].as_py()).slots(keys["key"].to_numpy().view(np.uint64))
            sums = np.frombuffer(counts["sums"][0].as_py(), "<i8")
            f[slots >= 0] = sums[slots[slots >= 0]]
        return pa.table({"size": keys["size"], "key": keys["key"], "f": pa.array(f)})

    both = wanted.groupBy("size", "shard").cogroup(counts.groupBy("size", "shard"))
    return both.applyInArrow(run, "size int, key long, f long")


def _spelt_once(candidates: DataFrame) -> DataFrame:
    """``candidates``; raises ValueError if a key has two spellings."""
    if candidates.groupBy("size", "key").count().filter("count > 1").limit(1).count():
        raise ValueError("two phrases share a key")
    return candidates


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (l * r)) in decimals, exact for counts below 10 to the 15."""
    wide = lambda c: f"CAST({c} AS decimal(15,0))"
    return F.expr(f"(CAST({SCALE} AS decimal(7,0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def scored(docs: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score, longer) of every candidate of ``docs`` (text, lang).

    ``longer`` is the greatest count of a longer candidate that holds it, or null.
    """
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    shards = 1 << (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    frequent: dict[int, bytes] = {}
    counts, totals = [], None
    for size in range(1, MOST_WORDS + 1):
        blocks = keep(_blocks(rows, size, shards, frequent.get(size - 1)), "blocks", "lz4")
        if totals is None:
            totals = blocks.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
        counts.append(counted(blocks, size))
        frequent[size] = bloom.held(_frequent(counts[-1]), "key")
    every = counts[0].unionByName(counts[1]).unionByName(counts[2])
    phrases = keep(_parted(_phrases(rows, counts[1].unionByName(counts[2]))), "parted")

    shard = F.shiftrightunsigned("key", 65 - shards.bit_length()).cast("int")
    told = _read(phrases.select("size", "key", shard.alias("shard")), every).filter(F.col("f") >= LEAST)
    own = _spelt_once(keep(phrases.join(told.withColumnRenamed("f", "a"), ["size", "key"]), "candidates"))

    part_size = F.when((F.col("size") == 3) & F.col("pos").isin(1, 2), 2).otherwise(1)
    asked = own.select("size", "key", F.posexplode("parts").alias("pos", "part")).withColumn("part_size", part_size)
    wanted = asked.select(F.col("part_size").alias("size"), F.col("part").alias("key")).distinct()
    found = keep(_read(wanted.withColumn("shard", shard), every), "found")
    told = asked.join(found.select(F.col("size").alias("part_size"), F.col("key").alias("part"), "f"), ["part_size", "part"])
    each = [F.max(F.when(F.col("pos") == k, F.col("f"))).alias(c) for k, c in enumerate(("l1", "r1", "l2", "r2"))]
    cuts = own.drop("parts").join(told.groupBy("size", "key").agg(*each), ["size", "key"])
    cuts = cuts.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    best = cuts.withColumns({c: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1")) for c, x in (("l", "l"), ("r", "r"), ("score", "s"))})

    inside = own.filter("size = 3").select("a", F.explode(F.array(F.col("parts")[1], F.col("parts")[2])).alias("key"))
    inside = inside.groupBy("key").agg(F.max("a").alias("longer")).withColumn("size", F.lit(2))
    return best.join(inside, ["size", "key"], "left").join(totals, "lang").select(
        "lang", "phrase", "size", "a", "l", "r", "n", "score", "longer"
    )


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` candidates that no longer one makes superfluous."""
    kept = scored(docs).filter(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) sizes(k))
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 10
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k > 1
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r,
    CAST((1000000 * c.a::HUGEINT * c.a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(words[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(words[cut + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, part, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS part FROM c WHERE k = 3)
  GROUP BY lang, part
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
  FROM best b JOIN totals USING (lang) LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase
  WHERE g.most IS NULL OR 100 * g.most < 50 * a
)
SELECT * FROM ranked WHERE rank <= 2000
"""
