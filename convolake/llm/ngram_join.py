"""Documents that share most of their word n-grams: an exact Jaccard join by universe partition and pigeonhole.

A document's set holds its distinct ``SHINGLE``-word shingles, A-Z as a-z, as
64-bit hashes (two of n different shingles are taken for one with a
probability of n * n / 4e19); a text with fewer words has its whole sequence
as one; one without words, or null, has none and links with nothing.  Sets are
alike if 100 * intersection >= 80 * union, so sets of a and b shingles differ
in (a + b) // 9 at most.

1. Sizes fall in bands, each 1.25 times the one before, so that alike sets
   lie in one band or in neighbouring ones.  For each band the universe of
   shingles is dealt by hash to one segment more than alike sets of that band
   can differ in.  A set is indexed in its own band and looks for others in
   that and in the one below.
2. If a set gives its segments allowances of 0, 1 or 2 that sum to more than
   the greatest difference, then with every alike set some segment differs in
   less than its allowance.  So it asks for equal subsets where it allows 1 and
   for those that differ in at most one shingle where it allows 2: they are
   equal, or one is the other without one shingle (the one-deletion
   neighbourhood).  Allowances are those of least cost: rows to be written, and
   documents to be met, as a bounded sample tells how often a shingle occurs.
   Costs choose the way, never the result.
3. Empty subsets and deletions are indexed only if some set may ask for them,
   as a Bloom filter tells.  Rows of (key, name of the set) are sorted by key;
   a key's first asker is its pivot.  Each set is compared first with the pivot
   that it shares most keys with, then with the others that are still in another
   component, then members of one key that still differ are compared, block
   against block.  Marks, whose number of bits follows the set's size, prove
   most pairs unlike; the rest is decided by the sets themselves.

Every set is compared once, however many documents have it.  Repeated rows and
rows of one doc_id are rows of their own; null doc_ids take part, and a
component's id is its smallest doc_id that isn't null.  Other columns are
ignored; a table without rows gives none.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm import bloom, words
from convolake.llm.components import components, spanning
from convolake.storage import keep, table

SHINGLE = 5
#: Documents in the sample that tells what is frequent, slots that it counts in, and slots that are told.
SAMPLE = 2_000
SLOTS = 1 << 22
TOLD = 1 << 16
#: The cost of asking for an empty subset.
EMPTY = 1e9
#: Sets that a worker remembers, so as to look at copies once.
SEEN = 500_000
#: Rows of one key that a task holds to see whether it has had the same members; more go by at once.
HELD = 1 << 20
#: Members of a key that are compared with as many others at a time, and columns of a product.
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 4096
LEAST_MARKS, MOST_MARKS = 64, 1 << 16
_WORD = words.flags(b" \t\n\x0b\f\r")
_RNG = np.random.default_rng(41)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)
_LEVEL, _KIND, _STEP = (int(x) | 1 for x in _RNG.integers(1, 1 << 62, 3))
_WHOLE = (1 << 64) - 1
_NAME = np.uint64((1 << 63) - 1)
_ASKS = np.uint64(1 << 63)


def differ(a: int, b: int) -> int:
    """The most that alike sets of ``a`` and ``b`` shingles can differ in."""
    return (a + b) // 9


@functools.cache
def bands() -> tuple[int, ...]:
    """The least size of each band."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(-(-5 * found[-1] // 4))
        if found[-1] == found[-2]:
            found[-1] += 1
    return tuple(found)


def band(size: int) -> int:
    return bisect_right(bands(), size) - 1


def largest(level: int) -> int:
    """The largest size in a band."""
    return bands()[level + 1] - 1


def sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    w = words.found(texts, _WORD)
    n = np.bincount(w.doc, minlength=len(texts)).tolist()
    h, out, at = w.hashes, [], 0
    spans = max(0, len(h) - shingle + 1)
    windows = np.zeros(spans, np.uint64)
    for k in range(shingle):
        windows += h[k : k + spans] * _PLACE[k]
    windows = words.mixed(windows)
    for count in n:
        if count >= shingle:
            x = np.sort(windows[at : at + count - shingle + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif count:
            out.append(words.mixed((h[at : at + count] * _PLACE[:count]).sum(keepdims=True) + _SHORT[count]))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


def name(x: np.ndarray) -> int:
    """The 63-bit name of a set that isn't empty."""
    return int(words.mixed(words.mixed(x).sum(keepdims=True) + np.uint64(len(x)))[0] & _NAME)


def marks(x: np.ndarray) -> bytes:
    """A power of two of bits, four or more for each shingle if that isn't too many; each shingle sets one."""
    bits = min(max(1 << (4 * len(x) - 1).bit_length(), LEAST_MARKS), MOST_MARKS)
    flags = np.zeros(bits, bool)
    flags[x & np.uint64(bits - 1)] = True
    return np.packbits(flags).tobytes()


def may_be_alike(a: bytes, b: bytes, a_size: int, b_size: int) -> bool:
    """False where marks prove two sets unlike: a bit that only one has stands for a shingle that only it has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = min(a_size - int(np.bitwise_count(x & ~y).sum()), b_size - int(np.bitwise_count(y & ~x).sum()))
    return 9 * both >= 4 * (a_size + b_size)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are alike."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)) or not len(x):
        return False
    merged = np.concatenate([x, y])
    merged.sort(kind="stable")
    return 9 * int(np.count_nonzero(merged[1:] == merged[:-1])) >= 4 * (len(x) + len(y))


def allowances(counts: np.ndarray, met: np.ndarray, need: int) -> np.ndarray:
    """0, 1 or 2 for each segment, ``need`` in all, at the least cost.

    ``counts`` are the subsets' sizes, ``met`` how many documents are
    expected to have one.  A second unit never costs less than the first, so
    taking the cheapest units gives the least sum.
    """
    once = np.where(counts > 0, 1 + met, EMPTY)
    twice = np.maximum(once, np.where(counts > 1, (1 + counts) * (1 + met), EMPTY))
    cheapest = np.argsort(np.concatenate([once, twice]), kind="stable")[:need]
    return np.bincount(cheapest % len(counts), minlength=len(counts))


def _keys(content: np.ndarray, segment: np.ndarray, level: int, deleted: bool) -> np.ndarray:
    start = np.uint64((level * _LEVEL + deleted * _KIND) & _WHOLE)
    return words.mixed(content + segment.astype(np.uint64) * np.uint64(_STEP) + start)


def signatures(x: np.ndarray, level: int, often: np.ndarray, weight: float) -> tuple[np.ndarray, ...]:
    """What a set asks for in a band, and what is indexed of it there if that is its own.

    (asked, wanted, listed, rare): the keys that it asks for; which of these
    are of a kind that is indexed only if it is wanted; of those that it
    doesn't ask for, the keys of its subsets, and those of its empty subsets
    and deletions.  ``often`` counts documents of the sample by slots of
    shingles, each of which stands for ``weight`` documents.
    """
    own = level == band(len(x))
    most = largest(level)
    m = differ(most, 5 * most // 4) + 1
    segment = ((words.mixed(x + np.uint64(level)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    segment = segment.astype(np.int64)
    each = words.mixed(x)
    counts = np.bincount(segment, minlength=m)
    content = np.zeros(m, np.uint64)
    np.add.at(content, segment, each)
    met = np.full(m, np.inf)
    np.minimum.at(met, segment, often[x & np.uint64(SLOTS - 1)] * weight)
    allowed = allowances(counts, np.where(counts > 0, met, 0.0), differ(len(x), len(x) if own else most) + 1)

    places = np.arange(m)
    whole, ones = _keys(content, places, level, False), allowed > 0
    twos, near = allowed == 2, (allowed == 2)[segment]
    without = content[segment] - each
    asked = [whole[ones], _keys(content[twos], places[twos], level, True), _keys(without[near], segment[near], level, False)]
    wanted = [(counts == 0)[ones], np.ones(int(twos.sum()), bool), (counts == 1)[segment[near]]]
    listed = rare = np.empty(0, np.uint64)
    if own:
        listed = whole[~ones & (counts > 0)]
        rare = np.concatenate([whole[~ones & (counts == 0)], _keys(without, segment, level, True)])
    return np.concatenate(asked), np.concatenate(wanted), listed, rare


def levels(size: int) -> list[int]:
    """The bands in which a set looks for others: its own and, if they can be alike, the one below."""
    own = band(size)
    return [own, own - 1] if own and 4 * size <= 5 * largest(own - 1) else [own]


def _fresh(texts: pa.Array, seen: set[int]) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(place, name, set, whether the worker hasn't seen it lately) of the texts with words."""
    for first, some in words.slices(texts):
        for k, x in enumerate(sets(some), first):
            if len(x):
                this = name(x)
                new = this not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(this)
                yield k, this, x, new


def _sampled(docs: DataFrame, total: int) -> np.ndarray:
    """Documents of a sample by slots of shingles; slots with less than three count as none."""
    some = docs.select("text").sample(min(1.0, SAMPLE / max(1, total)), seed=3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in words.slices(batch.column("text")):
                slots = [np.unique(x & np.uint64(SLOTS - 1)) for x in sets(part)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots).astype(np.int64))], names=["slot"])

    counts = some.mapInArrow(run, "slot long").groupBy("slot").agg(F.count("*").alias("n")).filter("n > 2")
    often = np.zeros(SLOTS, np.uint16)
    for r in counts.orderBy(F.desc("n"), "slot").limit(TOLD).collect():
        often[r["slot"]] = min(r["n"], 65535)
    return often


def _described(docs: DataFrame, often: np.ndarray, weight: float) -> DataFrame:
    """(doc_id, name, n, marks, wanted) of every row; marks and wanted once in a worker's partition for each set."""
    held = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = batch.num_rows
            names, sizes, bits, wanted = [None] * rows, [0] * rows, [None] * rows, [None] * rows
            for k, this, x, new in _fresh(batch.column("text"), seen):
                names[k], sizes[k] = this, len(x)
                if new:
                    bits[k] = marks(x)
                    found = [asked[rare] for asked, rare, *_ in (signatures(x, at, held.value, weight) for at in levels(len(x)))]
                    wanted[k] = np.concatenate(found).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(bits, pa.binary()), pa.array(wanted, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "name", "n", "marks", "wanted"])

    return docs.mapInArrow(run, "doc_id long, name long, n long, marks binary, wanted array<long>")


def _listed(docs: DataFrame, often: np.ndarray, weight: float, wanted: bytes) -> DataFrame:
    """(key, rank) of all sets; rank is the set's name, less 2 to the 63 where the set asks for the key."""
    context = docs.sparkSession.sparkContext
    counts, asked_for = context.broadcast(often), context.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, ranks = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for _, this, x, new in _fresh(batch.column("text"), seen):
                if not new:
                    continue
                for at in levels(len(x)):
                    asked, _, listed, rare = signatures(x, at, counts.value, weight)
                    rare = rare[bloom.may_hold(asked_for.value, rare)]
                    keys += [asked, listed, rare]
                    ranks += [np.full(len(asked), np.uint64(this) | _ASKS), np.full(len(listed) + len(rare), this, np.uint64)]
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (keys, ranks)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rank"])

    return docs.select("text").mapInArrow(run, "key long, rank long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, pivot) of keys that two sets or more have and one asks for; rows come by key and rank.

    Keys with the same members and pivot are told once, under a key of the
    members' own, unless they have more than ``HELD`` rows.
    """
    seen: set[int] = set()
    key, rank = np.empty(0, np.int64), np.empty(0, np.int64)
    going: tuple[int, int] | None = None  # the key and pivot of a run whose rows go by at once

    def told(key: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
        """Of whole runs."""
        if not len(key):
            return [key, key, key]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        once = new | np.concatenate([[True], rank[1:] != rank[:-1]])
        rank, new = rank[once], new[once]
        firsts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        names = rank & np.int64(_NAME)
        pivot = names[firsts]
        size = np.diff(np.append(firsts, len(rank)))
        members = np.add.reduceat(words.mixed(names.view(np.uint64)), firsts) + words.mixed(pivot.view(np.uint64) + np.uint64(1))
        good = np.zeros(len(firsts), bool)
        for k in np.flatnonzero((size > 1) & (rank[firsts] < 0)).tolist():
            if (this := int(members[k])) not in seen:
                seen.add(this)
                good[k] = True
        if len(seen) > SEEN:
            seen.clear()
        out = good[run]
        return [members.view(np.int64)[run][out], names[out], pivot[run][out]]

    def batch_of(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "name", "pivot"])

    for batch in batches:
        more_key, more_rank = (batch.column(c).to_numpy() for c in ("key", "rank"))
        parts = [[np.empty(0, np.int64)] * 3]
        if going and len(more_key):
            upto = int(np.searchsorted(more_key, going[0], "right"))
            these = more_rank[:upto] & np.int64(_NAME)
            parts.append([np.full(upto, going[0]), these, np.full(upto, going[1])])
            more_key, more_rank = more_key[upto:], more_rank[upto:]
            if len(more_key):
                going = None
        key, rank = np.concatenate([key, more_key]), np.concatenate([rank, more_rank])
        if len(key):
            last = int(np.searchsorted(key, key[-1]))
            parts.append(told(key[:last], rank[:last]))
            key, rank = key[last:], rank[last:]
            if len(key) > HELD:
                names = rank & np.int64(_NAME)
                going = (int(key[0]), int(names[0]))
                if rank[0] < 0:
                    parts.append([key, names, np.full(len(key), names[0])])
                else:  # nobody asks for it: its rows are dropped as they come
                    going = (going[0], -1)
                key, rank = key[:0], rank[:0]
        parts = [[c[p[2] >= 0] for c in p] for p in parts]
        yield batch_of(parts)
    yield batch_of([told(key, rank)])


def _texts(docs: DataFrame, described: DataFrame, names: DataFrame) -> DataFrame:
    """(name, text) of the sets that ``names`` lists; rows whose doc_id isn't among theirs aren't looked at."""
    ids = described.join(names, "name").groupBy("name").agg(F.min(F.xxhash64("doc_id")).alias("at"))
    held = docs.sparkSession.sparkContext.broadcast(bloom.held(ids, "at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            good = bloom.may_hold(held.value, batch.column("at").to_numpy())
            some = batch.filter(pa.array(good)).column("text")
            found = [(k, this) for k, this, _, new in _fresh(some, seen) if new]
            columns = [pa.array([x for _, x in found], pa.int64()), some.take(pa.array([k for k, _ in found], pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "text"])

    found = docs.select(F.xxhash64("doc_id").alias("at"), "text").mapInArrow(run, "name long, text string")
    return found.join(names, "name", "left_semi").dropDuplicates(["name"])


@functools.lru_cache(64)  # a pivot's many pairs lie side by side
def _set(text: str) -> np.ndarray:
    return sets([text.encode("utf-8", "surrogatepass")])[0]


def _likely(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs (a, b) of names whose marks don't prove them unlike."""

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, a_size: pd.Series, b_size: pd.Series) -> pd.Series:
        return pd.Series([may_be_alike(*x) for x in zip(a, b, a_size, b_size, strict=True)], dtype=bool)

    left, right = (sizes.select(F.col("name").alias(x), F.col("n").alias(f"{x}_n"), F.col("marks").alias(f"{x}_m")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b").filter(5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n"))
    return met.filter(likely("a_m", "b_m", "a_n", "b_n")).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of names whose sets are alike."""

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(_set(x), _set(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    left, right = (texts.select(F.col("name").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").filter(same("a_text", "b_text")).select("a", "b")


def _grouped(rows: DataFrame, by: tuple[str, ...], body, schema: str) -> DataFrame:
    """``body`` of the rows of each group, which blocks bound; rows are tuples with ``by`` first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        columns = [c.split()[0] for c in schema.split(",")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if held and row[: len(by)] != held[0][: len(by)]:
                    out += body(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=columns).astype("int64")
        yield pd.DataFrame(body(held) if held else [], columns=columns).astype("int64")

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def _near_members(rows: list[tuple]) -> list[tuple]:
    """(key, i, j, name, block, root) of the members of two blocks that may be alike with one of another root.

    ``rows`` have, after these, size and marks.  All marks are folded to the
    shortest ones, so a block is one matrix of bits.
    """
    width = min(len(r[7]) for r in rows) // 8
    bits = np.stack([np.bitwise_or.reduce(np.frombuffer(r[7], np.uint64).reshape(-1, width)) for r in rows])
    block, root, size = (np.array([r[k] for r in rows]) for k in (4, 5, 6))
    across = rows[0][1] != rows[0][2]
    good = np.zeros(len(rows), bool)
    for at in range(len(rows) - 1):
        rest = slice(at + 1, None)
        only_a = np.bitwise_count(bits[at] & ~bits[rest]).sum(axis=1, dtype=np.int64)
        only_b = np.bitwise_count(bits[rest] & ~bits[at]).sum(axis=1, dtype=np.int64)
        both = np.minimum(size[at] - only_a, size[rest] - only_b)
        near = (9 * both >= 4 * (size[at] + size[rest])) & (root[rest] != root[at])
        if across:
            near &= block[rest] != block[at]
        good[rest] |= near
        good[at] |= near.any()
    return [rows[k][:6] for k in np.flatnonzero(good).tolist()]


def _linked_roots(rows: list[tuple]) -> list[tuple]:
    """Links between the roots of alike sets; ``rows`` are (key, i, j, name, block, root, text)."""
    shared, sizes = overlaps([_set(r[6]) for r in rows])
    block, root = (np.array([r[k] for r in rows]) for k in (4, 5))
    near = (9 * shared >= 4 * (sizes[:, None] + sizes)) & (root[:, None] != root)
    if rows[0][1] != rows[0][2]:
        near &= block[:, None] != block
    return [(int(root[x]), int(root[y])) for x, y in spanning(near)]


def overlaps(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles every two sets share, and the sets' sizes."""
    sizes = np.array([len(x) for x in found])
    at, x = np.repeat(np.arange(len(found)), sizes), np.concatenate(found)
    order = np.argsort(x, kind="stable")
    at, x = at[order], x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    times = np.diff(np.append(np.flatnonzero(new), len(x)))
    often = np.repeat(times > 1, times)  # other shingles are shared with none
    at, number = at[often], (np.cumsum(new & often) - 1)[often]
    shared = np.zeros((len(found), len(found)))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, BLOCK_COLUMNS):
        a, b = np.searchsorted(number, [lo, lo + BLOCK_COLUMNS])
        part = np.zeros((len(found), BLOCK_COLUMNS), np.float32)
        part[at[a:b], number[a:b] - lo] = 1
        shared += part @ part.T
    return shared, sizes


def _across(shelves: DataFrame, roots: DataFrame, sizes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between roots of members of one key.

    Keys whose members are of the same several roots are looked at together,
    so that a set is met once with a group of roots, and not for each key that
    they share; each two blocks of such members meet in a task.
    """
    told = shelves.select("key", "name").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    held = told.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    held = held.agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(F.xxhash64("root").cast("decimal(38,0)")).alias("of"))
    several = held.filter("roots > 1 AND n > 2")  # of two, the one has met the other as its pivot
    told = told.join(several.select("key", F.xxhash64("of", "roots").alias("of")), "key")
    told = keep(told.select(F.col("of").alias("key"), "name", "root").distinct(), "mixed")
    several = told.groupBy("key").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    block = F.pmod(F.xxhash64("name", F.lit(5)), F.col("blocks")).cast("int")
    cut = told.join(several.select("key", blocks.alias("blocks")), "key").withColumn("block", block)
    each = cut.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = each.withColumn("i", F.least("block", "_t")).withColumn("j", F.greatest("block", "_t")).join(sizes, "name")
    by = ("key", "i", "j")
    schema = "key long, i int, j int, name long, block int, root long"
    likely = keep(_grouped(dealt.select(*by, "name", "block", "root", "n", "marks"), by, _near_members, schema), "likely")
    return _grouped(likely.join(texts, "name").select(*by, "name", "block", "root", "text"), by, _linked_roots, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(name, root) after links (a, b) between roots."""
    least = keep(components(links), "merged").select(F.col("id").alias("root"), F.col("root").alias("least"))
    moved = roots.join(least, "root", "left").select("name", F.coalesce("least", "root").alias("root"))
    return keep(moved.unionByName(least.select(F.col("root").alias("name"), F.col("least").alias("root"))).distinct(), "roots")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, n) of every row of ``docs`` (doc_id, text), and (name, root) of the sets that have a link."""
    total = docs.count()
    often, weight = _sampled(docs, total), max(1.0, total / SAMPLE)
    described = keep(_described(docs, often, weight), "described")
    wanted = bloom.held(described.select(F.explode("wanted").alias("key")), "key")
    sizes = described.filter("marks IS NOT NULL").select("name", "n", "marks").dropDuplicates(["name"])

    listed = _listed(docs, often, weight, wanted).repartition("key").sortWithinPartitions("key", "rank")
    shelves = keep(listed.mapInArrow(_runs, "key long, name long, pivot long").distinct(), "shelves")
    pairs = shelves.filter("name <> pivot").groupBy(F.col("name").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("keys"))
    pairs = keep(pairs, "pairs")
    texts = keep(_texts(docs, described, shelves.select("name").distinct()), "texts")

    # a set's likeliest partner first, so that most of the other pairs are within one component by then
    order = F.struct("keys", "b")
    first = _likely(pairs.groupBy("a").agg(F.max_by("b", order).alias("b")), sizes)
    roots = keep(components(_verified(first, texts)).withColumnRenamed("id", "name"), "roots")
    told = [roots.select(F.col("name").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
    rest = pairs.join(told[0], "a", "left").join(told[1], "b", "left")
    ends = [F.coalesce(f"{x}_root", x).alias(x) for x in "ab"]
    apart = rest.withColumns({"x": ends[0], "y": ends[1]}).filter("x <> y")
    apart = keep(_likely(apart.select("a", "b"), sizes), "apart")
    links = _verified(apart, texts).join(told[0], "a", "left").join(told[1], "b", "left").select(*ends)
    roots = _merged(roots, links)
    roots = _merged(roots, _across(shelves, roots, sizes, texts))
    return described.select("doc_id", "name", "n"), roots


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows, roots = classes(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    least = rows.filter("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"))
    named = keep(least.join(roots, "name", "left").select("name", "least", F.coalesce("root", "name").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(ids, "root").select("name", "component_id")
    joined = rows.join(ids, "name", "left")
    own = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the smallest doc_id of its component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
