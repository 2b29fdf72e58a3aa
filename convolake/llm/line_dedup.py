"""Fuzzy duplicate lines by MinHash, one line of each component kept.

A line is what stands between newlines; it is compared in lower case with runs
of white space as one space, by its set of ``SHINGLE`` character shingles (a
shorter line is one shingle).  Lines of white space alone are never touched.
Lines are alike at a Jaccard similarity of ``SIMILARITY`` or more; components
are over all documents, and of each the line with the smallest (doc_id, place,
row) stays, null doc_ids last.

1. Where the documents lie, each line gets a 64-bit name (a hash of the line as
   it is compared) and, once in a worker's partition, ``BANDS`` band hashes of
   ``ROWS`` MinHash values each: a pair at the threshold shares a band with a
   probability of 0.992, one at 0.85 with 0.9995, one at 0.9 with 0.99999.
   Two of n different lines get one name with a probability of n * n / 4e19.
2. Bands and names are shuffled in blocks, one for each of ``SLOTS`` slots that
   a batch of documents has bands in, and sorted slot by slot.  The first of a
   bucket in one of ``PIVOTS`` orders is its pivot, and all others are compared
   with it by exact Jaccard, unless their numbers of shingles alone put the
   threshold out of reach.  Slots that so many rows share that they would weigh
   down a task are dealt by name as well, and the pivots of their parts are
   compared with each other.
   Texts are fetched for compared lines alone: a Bloom filter whose size
   follows their number keeps the others from being shuffled.
3. Union-find by stars over the links gives components.  Members of one bucket
   whose components still differ are compared with each other, block against
   block within tasks by products of their shingle matrices, without those that
   marks prove unlike all others, so no link hangs on how good a pivot is, and
   neither pairs of one component nor those that aren't alike are ever written.
4. Lines whose name occurs twice or has a link get their component; its first
   line is found by partial aggregation, and all others are dropped.

Null and empty texts have no lines to drop.  Repeated rows are documents of
their own, told apart by their place in the scan.  A table without rows gives
none.  Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.llm import bloom
from convolake.llm.components import components
from convolake.llm.words import mixed
from convolake.storage import keep, table

#: One substituted character removes as many shingles: lines of 49 characters or more stay alike.
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 6
#: Members of a bucket that are compared with as many others at a time, and columns of a product.
BLOCK_ROWS = 1024
BLOCK_COLUMNS = 4096
#: Orders of names in which a bucket's first one is its pivot.
PIVOTS = 2
#: Bands fall in ``SLOTS`` slots; one with ``HOT_ROWS`` rows more than four times the mean, as a sample of documents has
#: them, is dealt in ``SALTS`` parts.  The sample says where rows are compared, not which.
SLOTS = 4096
SLOT_SAMPLE = 1 / 16
HOT_ROWS = 100_000
SALTS = 64
#: A name that holds more than one in ``FREQUENT`` of all lines is one of a broadcast table.
FREQUENT = 1000
#: Documents whose names are looked up in the Bloom filter at once.
LOOKED_UP = 512
CHUNK_CHARS = 1 << 16
#: Bits that are marked for a line's shingles, which prove most pairs unlike before any shingle is compared.
MARK_BITS = 1024
SEEN_NAMES = 500_000
#: Rounds in which shingles are thrown into a sketch's bins; what is empty after them takes a minimum of its own.
ROUNDS = 24
_BINS = BANDS * ROWS
_RNG = np.random.default_rng(11)
_THROW, _VALUE = (_RNG.integers(0, 1 << 32, ROUNDS + _BINS, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in "ab")
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_SPACES = [c for c in map(chr, range(sys.maxunicode)) if c.isspace() and c not in " \n"]


def normal(line: str) -> str:
    """A line as it is compared."""
    return " ".join(line.lower().split())


def name(line: str) -> int:
    """The name of a line as it is compared: a signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace"), 7)
    return value - (1 << 64) if value >> 63 else value


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(place, line) of a text's lines as they are compared, without blank ones."""
    text = (text or "").lower()
    odd = any(c in text for c in _SPACES)
    parts = [" ".join(x.split()) if odd or "  " in x else x.strip(" ") for x in text.split("\n")]
    return [(i, x) for i, x in enumerate(parts) if x]


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines side by side, short ones filled up to a shingle, and their lengths."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    return codes, np.array([len(x) for x in padded])


def _whole(lengths: np.ndarray) -> np.ndarray:
    """Which windows of ``SHINGLE`` characters lie in one line."""
    mask = np.ones(int(lengths.sum()), bool)
    ends = np.cumsum(lengths)
    for back in range(1, SHINGLE):
        mask[ends - back] = False
    return mask[: len(mask) - SHINGLE + 1]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit hash of every shingle, and how many each line has with repeats; no line is empty."""
    codes, lengths = _codes(lines)
    h = (codes + np.uint32(1)) * _MIX[0]
    for width, factor in ((1, _MIX[1]), (2, _MIX[2]), (1, _MIX[3])):  # 2, 4 and 5 characters
        h ^= h >> np.uint32(15)
        h = h[:-width] * factor + h[width:]
    h ^= h >> np.uint32(16)
    return h[_whole(lengths)], lengths - SHINGLE + 1


def band_hashes(lines: list[str]) -> np.ndarray:
    """A row of ``BANDS`` signed 64-bit hashes for each line; no line is empty.

    A sketch has a bin for each MinHash value.  In each round every shingle is
    thrown in one bin with a value, earlier rounds before later ones, and a bin
    holds its least.  So a bin is equal in two lines as often as their shingles
    overlap, and long lines need one round.
    """
    x, counts = shingle_hashes(lines)
    base = np.repeat(np.arange(len(lines)) * _BINS, counts)
    sketch = np.full(len(lines) * _BINS, 0xFFFFFFFF, np.uint32)
    empty = np.ones(len(lines), bool)
    for k in range(ROUNDS):
        if k:
            empty = (sketch.reshape(-1, _BINS) == 0xFFFFFFFF).any(axis=1)
            if not empty.any():
                break
            still = np.repeat(empty, counts)
            x, base, counts = x[still], base[still], np.where(empty, counts, 0)
        g = x * _THROW[k]
        g ^= g >> np.uint32(15)
        at = base + (((g >> np.uint32(16)) * np.uint32(_BINS)) >> np.uint32(16))
        np.minimum.at(sketch, at, ((x * _VALUE[k]) >> np.uint32(6)) | np.uint32(k << 26))
    rows = sketch.reshape(-1, _BINS)
    if (rows == 0xFFFFFFFF).any():
        firsts = np.cumsum(counts) - counts
        short = np.flatnonzero(counts)
        for b in range(_BINS):
            if (rows[short, b] == 0xFFFFFFFF).any():
                least = np.minimum.reduceat((x * _VALUE[ROUNDS + b]) >> np.uint32(6), firsts[short]) | np.uint32(ROUNDS << 26)
                rows[short, b] = np.minimum(rows[short, b], least)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(lines), 1))
    for k in range(ROWS):
        out = (out ^ rows[:, k::ROWS]) * _FOLD
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _chunks(lines: list[str]) -> list[np.ndarray]:
    """Numbers of lines in groups of about ``CHUNK_CHARS`` characters, lines of one length side by side."""
    lengths = np.array([len(x) for x in lines], np.int64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.cumsum(lengths[order]) // CHUNK_CHARS
    return np.split(order, np.flatnonzero(np.diff(cuts)) + 1) if lines else []


def _all_bands(lines: list[str]) -> np.ndarray:
    """``band_hashes`` of any number of lines, some at a time."""
    out = np.zeros((len(lines), BANDS), np.int64)
    for some in _chunks(lines):
        out[some] = band_hashes([lines[k] for k in some])
    return out


@functools.lru_cache(256)  # a pivot's many pairs lie side by side
def shingles(line: str) -> frozenset[str]:
    """The character shingles of a line as it is compared."""
    return frozenset([line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))])


@functools.lru_cache(256)
def keys(line: str) -> np.ndarray | None:
    """The shingles as sorted numbers, 12 bits a character; None for lines with other characters or less than a shingle."""
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    if len(codes) < SHINGLE or codes.max() >= 1 << 12:
        return None
    n = len(codes) - SHINGLE + 1
    key = codes[:n]
    for k in range(1, SHINGLE):
        key = (key << 12) | codes[k : n + k]
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])]


def jaccard(a: str, b: str) -> float:
    """The similarity of two lines as they are compared."""
    x, y = keys(a), keys(b)
    if x is None or y is None:
        x, y = shingles(a), shingles(b)
        both = len(x & y)
    else:
        merged = np.concatenate([x, y])
        merged.sort(kind="stable")
        both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both / (len(x) + len(y) - both)


def incidence(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, shingle) of every different shingle of each line, in order, and the lines' numbers of them.

    Characters are numbered within the block, so that a shingle is one number
    without any hashing.
    """
    codes, lengths = _codes(lines)
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    at = (np.cumsum(used) - 1)[codes]
    bits = int(at.max()).bit_length() or 1
    n = len(at) - SHINGLE + 1
    if bits * SHINGLE < 64:
        key = np.zeros(n, np.int64)
        for k in range(SHINGLE):
            key = (key << bits) | at[k : n + k]
    else:
        key = np.unique(np.stack([at[k : n + k] for k in range(SHINGLE)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    key = key[_whole(lengths)]
    line = np.repeat(np.arange(len(lines)), lengths - SHINGLE + 1)
    room = int(key.max()).bit_length()
    if room + len(lines).bit_length() < 64:
        both = np.sort((line << room) | key)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        line, key = both >> room, both & ((1 << room) - 1)
    else:
        order = np.lexsort((key, line))
        line, key = line[order], key[order]
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (key[1:] != key[:-1])])
        line, key = line[new], key[new]
    return line, key, np.bincount(line, minlength=len(lines))


def marks(line: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """``MARK_BITS`` bits for each of ``n`` lines, one set by each of its shingles; ``key`` must not depend on the block."""
    flags = np.zeros((n, MARK_BITS), bool)
    flags[line, key % np.uint32(MARK_BITS)] = True
    return np.packbits(flags, axis=1)


def may_be_alike(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """False where marks prove a similarity below the threshold.

    A bit that only one line has stands for a shingle that only it has, so
    what both have is bounded by either line's number of shingles.
    """
    a, b = a.view(np.uint64), b.view(np.uint64)
    both = np.minimum(a_size - np.bitwise_count(a & ~b).sum(axis=1), b_size - np.bitwise_count(b & ~a).sum(axis=1))
    return both >= SIMILARITY * (a_size + b_size - both)


def may_link(bits: np.ndarray, sizes: np.ndarray, split: int) -> np.ndarray:
    """What ``may_be_alike`` says of each of the first ``split`` lines and each line after them; with 0, of all lines and all."""
    flags = np.unpackbits(bits, axis=1).astype(np.float32)
    left = slice(0, split) if split else slice(0, len(bits))
    both, a_size, b_size = flags[left] @ flags[split:].T, sizes[left, None], sizes[None, split:]
    times = flags.sum(axis=1)
    both = np.minimum(a_size - times[left, None] + both, b_size - times[None, split:] + both)
    return both >= SIMILARITY * (a_size + b_size - both)


def overlaps(lines: list[str], split: int) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each of the first ``split`` lines shares with each line after them, and all lines' numbers of shingles.

    With ``split`` 0 all lines are compared with all others.
    """
    line, key, sizes = incidence(lines)
    order = np.argsort(key, kind="stable")
    line, key = line[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    times = np.diff(np.append(np.flatnonzero(new), len(key)))
    often = np.repeat(times > 1, times)  # other shingles are shared with none
    line, number = line[often], (np.cumsum(new & often) - 1)[often]
    left = slice(0, split) if split else slice(0, len(lines))
    shared = np.zeros((split or len(lines), len(lines) - split))
    used = int(number[-1]) + 1 if len(number) else 0
    for at in range(0, used, BLOCK_COLUMNS):
        lo, hi = np.searchsorted(number, [at, at + BLOCK_COLUMNS])
        part = np.zeros((len(lines), min(BLOCK_COLUMNS, used - at)), np.float32)
        part[line[lo:hi], number[lo:hi] - at] = 1
        shared += part[left] @ part[split:].T
    return shared, sizes


def _packed(values: np.ndarray, ends: list[int] | np.ndarray) -> pa.BinaryArray:
    """Rows of 64-bit numbers as one binary value for each of the slices that end at ``ends``, the first of which is 0."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    offsets = pa.array(np.asarray(ends, np.int64) * width).cast(pa.int32())
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(packed: list[bytes]) -> np.ndarray:
    """The 64-bit numbers of some binary values side by side."""
    return np.frombuffer(b"".join(packed), np.int64)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: the names of its lines by place, and bands of those that the worker hasn't seen lately."""
    seen: set[int] = set()
    for batch in batches:
        names, n_lines, ends, new, lines = [], [], [0], [], []
        for text in batch.column("text"):
            found = _lines(text.as_py())
            these = [name(line) for _, line in found]
            for this, (_, line) in zip(these, found, strict=True):
                if this not in seen:
                    seen.add(this)
                    new.append(this)
                    lines.append(line)
            by_place = [None] * (found[-1][0] + 1 if found else 0)
            for this, (place, _) in zip(these, found, strict=True):
                by_place[place] = this
            names.append(by_place)
            n_lines.append(len(found))
            ends.append(len(new))
        if len(seen) > SEEN_NAMES:
            seen.clear()
        packed = [_packed(np.array(new, np.int64), ends), _packed(_all_bands(lines), ends)]
        columns = [batch.column("row"), batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(names, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, *packed], names=["row", "doc_id", "n_lines", "names", "fresh", "bands"])


def _texts(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, line, size, marks) of the lines that ``names`` lists; size is the number of different shingles."""
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom.held(names, "name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found: dict[int, str] = {}
            for at in range(0, batch.num_rows, LOOKED_UP):
                lines = [line for text in batch.column("text").slice(at, LOOKED_UP).to_pylist() for _, line in _lines(text)]
                these = [name(line) for line in lines]
                for k in np.flatnonzero(bloom.may_hold(filter_.value, np.array(these, np.int64))).tolist():
                    if these[k] not in seen:
                        seen.add(these[k])
                        found[these[k]] = lines[k]
            if len(seen) > SEEN_NAMES:
                seen.clear()
            lines = list(found.values())
            sizes, bits_set = np.zeros(len(lines), np.int64), np.zeros((len(lines), MARK_BITS // 8), np.uint8)
            for some in _chunks(lines):
                these = [lines[k] for k in some]
                sizes[some] = incidence(these)[2]
                hashes, counts = shingle_hashes(these)
                bits_set[some] = marks(np.repeat(np.arange(len(these)), counts), hashes, len(these))
            columns = [pa.array(list(found), pa.int64()), pa.array(lines, pa.string()), pa.array(sizes)]
            columns.append(pa.array([x.tobytes() for x in bits_set], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["name", "line", "size", "marks"])

    found = docs.select("text").mapInArrow(run, "name long, line string, size long, marks binary")
    return found.join(names, "name", "left_semi").dropDuplicates(["name"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of names whose lines are alike."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series, a_size: pd.Series, b_size: pd.Series, a_marks: pd.Series, b_marks: pd.Series) -> pd.Series:
        bits = [np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a_marks, b_marks)]
        out = may_be_alike(*bits, a_size.to_numpy(), b_size.to_numpy()) if len(a) else np.zeros(0, bool)
        for k in np.flatnonzero(out).tolist():
            out[k] = jaccard(a.iat[k], b.iat[k]) >= SIMILARITY
        return pd.Series(out)

    columns = ("line", "size", "marks")
    left, right = (texts.select(F.col("name").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns]) for x in "ab")
    within = F.least("a_size", "b_size") >= SIMILARITY * F.greatest("a_size", "b_size")  # Jaccard is no more than their ratio
    met = pairs.join(left, "a").join(right, "b").filter(within)
    return met.filter(alike("a_line", "b_line", "a_size", "b_size", "a_marks", "b_marks")).select("a", "b")


def _turn(bands: np.ndarray) -> np.ndarray:
    """What a bucket's names are turned by to find its pivot: in one order they compare as they are, in the next with their bits turned, and so on."""
    return (bands % PIVOTS) * np.int64(0x5DEECE66D1CE4E5B)


def _buckets(bands: np.ndarray, names: np.ndarray, parted: bool) -> list[np.ndarray]:
    """band, name, pivot and many of the members of buckets of two or more; where they are parted, of those alone in theirs, too."""
    order = np.argsort(bands)
    bands = bands[order]
    keys = names[order] ^ _turn(bands)
    starts = np.flatnonzero(np.concatenate([[True], bands[1:] != bands[:-1]]))
    sizes = np.diff(np.append(starts, len(bands)))
    if not parted:
        shared = np.repeat(sizes > 1, sizes)
        bands, keys, sizes = bands[shared], keys[shared], sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
    if not len(bands):
        return [bands, bands, bands, np.zeros(0, bool)]
    run, least = np.repeat(np.arange(len(starts)), sizes), np.minimum.reduceat(keys, starts)
    order = np.lexsort((keys, run))  # the first of a run is its pivot
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[order[1:]] == keys[order[:-1]]) & (run[1:] == run[:-1])
    left = order[~again]
    times = np.bincount(run[left], minlength=len(starts))
    out = left[(times[run[left]] > 1) | parted]
    turn = _turn(bands[out])
    return [bands[out], keys[out] ^ turn, least[run[out]] ^ turn, (times[run[out]] > 2) | parted]


def _shelves(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, name, pivot, many) of the lines in buckets of two or more, and pairs (a, b) of pivots of one hot band.

    Bands are dealt by slot in blocks, so a task holds one slot's at a time.
    Hot slots are dealt by name, too, and lines alone in their part are among
    the rows, with themselves as pivot.  ``many`` is false where a bucket has
    two names.
    """

    n_slots, salts = SLOTS, SALTS  # workers have their own copy of this module

    def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = np.bincount(_numbers(batch.column("bands").to_pylist()) % n_slots)
            slots = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(times[slots])], names=["slot", "n"])

    sampled = kept.select("bands").sample(SLOT_SAMPLE, seed=1).mapInArrow(slot_counts, "slot long, n long")
    slots = sampled.groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS rows at most
    mean = sum(r["n"] for r in slots) / SLOTS
    hot = np.array([r["slot"] for r in slots if r["n"] > HOT_ROWS * SLOT_SAMPLE + 4 * mean], np.int64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = _numbers(batch.column("bands").to_pylist())
            names = np.repeat(_numbers(batch.column("fresh").to_pylist()), BANDS)
            at = (bands % n_slots) * (salts + 1)
            if len(hot):
                split = np.isin(bands % n_slots, hot)
                at[split] += 1 + (mixed(names[split].view(np.uint64)) % np.uint64(salts)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at = at[order]
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            ends = np.append(starts, len(at))
            columns = [pa.array(x) for x in (at[starts] // (salts + 1), at[starts] % (salts + 1))]
            columns += [_packed(bands[order], ends), _packed(names[order], ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "part", "bands", "names"])

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        place, names = None, ["band", "name", "pivot", "many", "part"]

        def told() -> list[np.ndarray]:
            found = _buckets(*(_numbers(list(x)) for x in zip(*held, strict=True)), place[1] > 0)
            held.clear()
            return [*found, np.full(len(found[0]), place[1], np.int64)]

        for batch in batches:
            out = []
            for slot, part, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and place != (slot, part):
                    out.append(told())
                place = slot, part
                held.append(tuple(block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told()], names=names)

    laid = kept.select("fresh", "bands").mapInArrow(blocks, "slot long, part long, bands binary, names binary")
    dealt = laid.repartition("slot", "part").sortWithinPartitions("slot", "part")
    shelves = keep(dealt.mapInArrow(shelved, "band long, name long, pivot long, many boolean, part long"), "shelves")
    heads = shelves.filter("part > 0").select("band", "pivot").distinct()
    firsts = heads.groupBy("band").agg(F.min("pivot").alias("first"), F.max("pivot").alias("last")).filter("first < last")
    tied = heads.join(firsts, "band").filter("pivot <> first").select(F.col("first").alias("a"), F.col("pivot").alias("b"))
    return shelves.drop("part"), tied


def _joined(alike: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) for all but the first of each component of a symmetric matrix."""
    left, found = np.ones(len(alike), bool), []
    for seed in np.flatnonzero(alike.any(axis=1)).tolist():
        front = np.array([seed]) if left[seed] else np.empty(0, int)
        left[seed] = False
        while len(front):
            front = np.flatnonzero(alike[front].any(axis=0) & left)
            left[front] = False
            found += [(int(x), seed) for x in front]
    return found


def _across(unlinked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links (a, b) between roots that members of one bucket have; ``unlinked`` has band, name, root, line, size, marks, ``sizes`` band, blocks.

    Members are cut in blocks by name, and every two blocks of a bucket are
    compared within a task, which gives links between different roots alone.
    Lines that their marks prove unlike all that have another root are left
    out before shingles are compared.
    """
    cut = unlinked.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("name", F.lit(5)), F.col("blocks")).cast("int"))
    each = cut.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = each.withColumn("i", F.least("block", "_t")).withColumn("j", F.greatest("block", "_t"))

    def compared(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1:3]
        rows.sort(key=lambda r: r[3] != i)
        roots = np.array([r[4] for r in rows])
        split = sum(r[3] == i for r in rows) if i != j else 0
        if split == len(rows) or (roots == roots[0]).all():
            return []
        left = slice(0, split or len(rows))
        bits = np.frombuffer(b"".join([r[7] for r in rows]), np.uint8).reshape(len(rows), -1)
        may = may_link(bits, np.array([r[6] for r in rows]), split) & (roots[left, None] != roots[None, split:])
        some = np.concatenate([may.any(axis=1), may.any(axis=0)]) if split else may.any(axis=1)
        if not some.any():
            return []
        rows, roots, split = [rows[k] for k in np.flatnonzero(some)], roots[some], int(some[:split].sum())
        left = slice(0, split or len(rows))
        shared, sizes = overlaps([r[5] for r in rows], split)
        union = sizes[left, None] + sizes[None, split:] - shared
        near = (shared >= SIMILARITY * union) & (roots[left, None] != roots[None, split:])
        if not near.any():
            return []
        alike = near
        if split:
            alike = np.zeros((len(rows), len(rows)), bool)
            alike[:split, split:], alike[split:, :split] = near, near.T
        return [(int(roots[x]), int(roots[y])) for x, y in _joined(alike)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if held and row[:3] != held[0][:3]:
                    out += compared(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        if held:
            yield pd.DataFrame(compared(held), columns=["a", "b"]).astype("int64")

    ordered = dealt.select("band", "i", "j", "block", "root", "line", "size", "marks").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return ordered.mapInPandas(run, "a long, b long")


def classes(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, root) of the names that have a link; ``kept`` is what ``_named`` gives for ``docs``."""
    shelves, tied = _shelves(kept)
    pairs = shelves.filter("name <> pivot").select(F.least("name", "pivot").alias("a"), F.greatest("name", "pivot").alias("b"))
    pairs = keep(pairs.unionByName(tied).distinct(), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    texts = keep(_texts(docs, named), "texts")
    roots = keep(components(_verified(pairs, texts)), "roots").withColumnRenamed("id", "name")

    told = shelves.filter("many").join(roots, "name", "left").select("band", "name", F.coalesce("root", "name").alias("root")).distinct()
    unlike = told.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    several = unlike.filter("lo < hi AND n > 2").select("band")  # where there are two, the other has met the pivot
    unlinked = keep(told.join(several, "band").join(texts, "name"), "unlinked")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / (BLOCK_ROWS << 11)))
    merged = keep(components(_across(unlinked, unlinked.groupBy("band").agg(blocks.alias("blocks")))), "merged")
    least = merged.select(F.col("id").alias("root"), F.col("root").alias("least"))
    moved = roots.join(least, "root", "left").select("name", F.coalesce("least", "root").alias("root"))
    return moved.unionByName(least.select(F.col("root").alias("name"), F.col("least").alias("root"))).distinct()


def _met(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """``left`` joined with ``right`` (key, n, ...), n being the rows of ``left`` with that key, of ``total``.

    Keys with more than one in ``FREQUENT`` of the rows are no more than
    ``FREQUENT``; they are broadcast, and their rows stay where they are.
    """
    often = F.col("n") > math.ceil(total / FREQUENT)
    frequent = F.broadcast(right.filter(often))
    seldom = left.join(frequent.select(key), key, "left_anti").join(right.filter(~often), key)
    return left.join(frequent, key).unionByName(seldom).drop("n")


def dropped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, place, root) of the lines of ``docs`` (row, doc_id, text) that are dropped, and (row, doc_id, n_lines) of all documents."""
    schema = "row long, doc_id long, n_lines long, names array<long>, fresh binary, bands binary"
    kept = keep(docs.select("row", "doc_id", "text").mapInArrow(_named, schema), "lines")
    roots = classes(kept, docs)
    total = kept.agg(F.sum("n_lines")).first()[0] or 0
    lines = kept.select("row", "doc_id", F.posexplode("names").alias("place", "name")).filter("name IS NOT NULL")
    counted = lines.groupBy("name").agg(F.count("*").alias("n")).join(roots, "name", "left")
    several = counted.filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "name"))
    several = keep(several.select("name", "n", "root"), "several")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "place", "row")
    members = keep(_met(lines, several, "name", total).select("root", order.alias("at")), "members")
    sizes = several.groupBy("root").agg(F.sum("n").alias("n"))
    firsts = members.groupBy("root").agg(F.min("at").alias("first")).join(sizes, "root")
    gone = _met(members, firsts, "root", total).filter("at <> first")
    return gone.select("at.row", "at.place", "root"), kept.select("row", "doc_id", "n_lines")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines, and the places and classes of those that are dropped."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, rows = dropped(docs.withColumn("row", F.monotonically_increasing_id()))
    per_doc = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "root"))).alias("gone"))
    return rows.join(per_doc, "row", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.transform("gone", lambda g: g["place"]), F.array().cast("array<int>")).alias("dropped_lines"),
        F.coalesce(F.transform("gone", lambda g: g["root"]), F.array().cast("array<long>")).alias("classes"),
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without duplicate lines; documents that had lines and have none left go.

    Documents are written with their row numbers first, since a plan that is
    run twice need not number them alike.
    """

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, places in zip(texts, gone, strict=True):
            drop = set() if text is None else set(places.tolist())
            out.append(None if text is None else "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop]))
        return pd.Series(out, dtype=object)

    numbered = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = keep(numbered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found, counts = dropped(rows.select("row", "doc_id", "text"))
    gone = found.groupBy("row").agg(F.collect_list("place").alias("gone")).join(counts.select("row", "n_lines"), "row")
    joined = rows.join(gone, "row", "left").filter(F.col("gone").isNull() | (F.size("gone") < F.col("n_lines")))
    cut = without(F.when(F.col("gone").isNotNull(), F.col("text")), "gone")  # a UDF sees every row, but not every text
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut)
    return joined.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
