"""Token ids as directly addressable codes, in files that give any token on its own.

An id is split into chunks of eight bits.  Level 0 holds the lowest chunk of
every id, level 1 the next chunk of those ids that have one, and so on.  Each
level but the last has a bitmap that says which of its chunks go on, and a
rank directory: the number of set bits before every block of 512 bits.  Token
i is level 0's chunk i; where bit i is set, the next chunk is level 1's at the
rank of i, which takes one directory entry and a popcount of at most 64 bytes.
No block is ever decoded.

Layout of a segment, little-endian: ``DAC1``, u32 number of levels, u32
number of documents, then for each level u32 count n, n bytes of chunks, and
for each but the last the bitmap of (n + 7) // 8 bytes and (n + 511) // 512
directory entries of u32; at the end the documents' first tokens as u64, plus
the total.

Segments are rows of a Parquet table (pid, seq, within,
n_tokens, doc_ids, payload): every store
that Spark writes to can hold it, and a lost executor's tasks are run anew under
Spark's commit protocol.  Documents are dealt by ranges of doc_id, so (pid,
seq) is the order of the table, nulls last; repeated doc_ids lie side by side,
ordered by a hash of their texts.  A segment closes at ``SEGMENT_TOKENS``; one document
is never cut, and a longer one has a segment to itself.

A null text counts as empty: it has the end id alone.  Other columns are
ignored.  No documents give a table without rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.storage import fresh_path, table

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SEGMENT_TOKENS = 1 << 18
CHUNK_BITS = 8
BLOCK_BITS = 512
CACHE_ENTRIES = 400_000
CACHE_KEY = 48
_MARK = re.compile(rb"(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])")
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_COMBINING = re.compile("[\u0300-\u036f]")
#: Byte-level vocabularies write printable bytes as themselves and the others as U+0100 and on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def pack(ids: np.ndarray, firsts: np.ndarray) -> bytes:
    """A segment of ``ids`` whose documents begin at ``firsts`` (with the total at the end)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> CHUNK_BITS
        more = rest > 0
        if not more.any():
            levels.append(struct.pack("<I", len(chunks)) + chunks.tobytes())
            break
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        levels.append(struct.pack("<I", len(chunks)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more]
    return struct.pack("<4sII", b"DAC1", len(levels), len(firsts) - 1) + b"".join(levels) + firsts.astype("<u8").tobytes()


class Segment:
    """A packed segment; nothing is decoded until a token is asked for."""

    def __init__(self, payload: bytes) -> None:
        magic, n_levels, self.n_docs = struct.unpack_from("<4sII", payload)
        if magic != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 12
        for level in range(n_levels):
            (n,) = struct.unpack_from("<I", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            at += 4 + n
            if level == n_levels - 1:
                self.levels.append((chunks, None, None))
                break
            bits = np.frombuffer(payload, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", (n + BLOCK_BITS - 1) // BLOCK_BITS, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))
        self.firsts = np.frombuffer(payload, "<u8", self.n_docs + 1, at)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """Token ``i``, by one directory entry and one popcount a level."""
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << CHUNK_BITS * level
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            whole = bits[block * BLOCK_BITS // 8 : i >> 3]
            within = int(bits[i >> 3]) & (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(_POPCOUNT[whole].sum()) + int(_POPCOUNT[within])
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Tokens ``lo`` up to ``hi`` as u32; only their own chunks are touched."""
        out = np.zeros(hi - lo, np.uint32)
        slots = np.arange(hi - lo)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[slots] |= chunks[lo:hi].astype(np.uint32) << CHUNK_BITS * level
            if bits is None or lo == hi:
                break
            more = np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            block = lo // BLOCK_BITS
            before = np.unpackbits(bits[block * BLOCK_BITS // 8 : (lo + 7) >> 3], bitorder="little")
            slots = slots[more]
            lo = int(ranks[block]) + int(before[: lo - block * BLOCK_BITS].sum())
            hi = lo + len(slots)
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of document ``k`` of the segment."""
        return self.tokens(int(self.firsts[k]), int(self.firsts[k + 1]))


class Encoder:
    """The tokenizers library over words that are cut at ASCII white space.

    The vocabulary's normalizer and patterns never join anything across white
    space, so a text's ids are its words' ids; a worker asks the library once
    for each word it hasn't seen lately.  The vocabulary's added tokens are found
    in the text as it is, before anything else, and have their own ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._added = {t: struct.pack("<I", i) for t, i in added.items()}
        self._cuts = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True))) or '(?!)'})")
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    @classmethod
    @functools.cache
    def load(cls, path: str) -> Encoder:
        return cls(path)

    def _words(self, text: str) -> list[bytes]:
        """The text's words, cut before ASCII punctuation that follows an ASCII letter.

        The vocabulary starts anew there.  It ignores case, too, so words are
        remembered in lower case; only where combining marks may change what a
        capital is composed to is the case left alone.
        """
        try:
            text.encode("latin-1")
            raw = text.lower().encode()
        except UnicodeEncodeError:
            raw = text.encode("utf-8", "replace")
            raw = raw if _COMBINING.search(text) else raw.lower()
        return _MARK.sub(b" ", raw).split()

    def _ask(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The library's ids for words.  Runs of lower-case letters need no normalizing and go straight to its model."""
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        tokenize = self.library.model.tokenize
        ids = {w: array("I", [t.id for t in tokenize(w.decode("latin-1").translate(_BYTE_LEVEL))]).tobytes() for w in plain}
        if len(plain) < len(words):
            rest = [w for w in words if w not in ids]
            found = self.library.encode([w.decode() for w in rest], is_pretokenized=True, add_special_tokens=False)
            every = np.array(found.ids, "<u4")
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(rest) + 1)).tolist()
            ids.update((w, every[i:j].tobytes()) for w, i, j in zip(rest, ends, ends[1:], strict=False))
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian u32."""
        parts = self._cuts.split(text or "")
        if len(parts) == 1:
            return self._between(parts[0])
        return b"".join([self._added[part] if k % 2 else self._between(part) for k, part in enumerate(parts)])

    def _between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        words = self._words(text)
        known = self._known
        fresh = set(words).difference(known)
        if fresh:
            if len(known) + len(fresh) > CACHE_ENTRIES:  # what is still in use comes back from the older half
                self._older, self._known = known, {}
                known, fresh = self._known, set(words)
            older = self._older
            known.update([(w, older[w]) for w in fresh if w in older])
            known.update(self._ask([w for w in fresh if w not in known]))
            joined = b"".join(map(known.__getitem__, words))
            for w in fresh:
                if len(w) > CACHE_KEY:
                    del known[w]
            return joined
        return b"".join(map(known.__getitem__, words))


def write(docs: DataFrame, path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode (doc_id, text) by ``VOCABULARY``, whose rules ``Encoder`` relies on, and write segments in ascending doc_id order.

    The texts are dealt out and sorted first, so that ids are made where they
    are written and never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(public_tokenizers.path(VOCABULARY))
        end = struct.pack("<I", end_id)
        seq, within, held, names, size = 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            firsts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])])
            payload = pack(np.frombuffer(b"".join(held), "<u4"), firsts)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            row = (pid, seq, within, size, list(names), payload)
            columns = [pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["pid", "seq", "within", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column("pid")[0].as_py()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                if held and size + len(ids) // 4 > segment_tokens:
                    yield close()
                    seq, within, held, names, size = seq + 1, within + size, [], [], 0
                held.append(ids)
                names.append(doc_id)
                size += len(ids) // 4
        if held:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), tie)
    ranked = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), tie).withColumn("pid", F.spark_partition_id())
    schema = "pid int, seq int, within long, n_tokens long, doc_ids array<long>, payload binary"
    ranked.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def starts(segments: DataFrame) -> DataFrame:
    """(pid, base): the tokens of all partitions before each; one row a partition of the writing job."""
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    return parts.select("pid", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, payload in zip(*(batch.column(c) for c in ("start", "doc_ids", "payload")), strict=True):
                segment = Segment(payload.as_py())
                firsts = segment.firsts.astype(np.int64)
                ids = [segment.document(k).astype("<u4").tobytes() for k in range(segment.n_docs)]
                columns = [names.values, pa.array(firsts[:-1] + start.as_py()), pa.array(np.diff(firsts)), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    placed = segments.join(F.broadcast(starts(segments)), "pid")  # as many rows as the writing job had partitions
    start = F.col("base") + F.col("within")
    return placed.select(start.alias("start"), "doc_ids", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )


def op4_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files."""
    path = fresh_path(spark, "dac")
    write(table(spark, sf_dir, "documents"), path)
    found = read(spark.read.parquet(path))

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(zlib.crc32).astype("int64")

    return found.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))
