"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in one bucket per merge rank; a bucket holds
positions of a linked list of symbols.  A two-level bitmap marks the ranks
whose buckets hold something, so find-first-set gives the next rank.  A
position is stale, and is skipped, if its symbol has been merged away or its
pair has another rank by now.  The cost is the pre-token's length times the
log of a bucket's, so a pre-token of a megabyte is as good as many short ones.

Texts are encoded where they lie: one narrow stage, no shuffle.  Each Python
worker keeps the ids of chunks that it has seen, in dicts of bounded size.

A null text counts as empty and has no ids.  A null doc_id stays null,
repeated rows stay repeated, and other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolake.storage import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Most entries of each of a worker's two dicts, and the longest key that is kept.
CACHE_ENTRIES = 500_000
CACHE_KEY = 48
LEVEL_BITS = 8
LEVEL_MASK = (1 << LEVEL_BITS) - 1
#: White space by Unicode's property, which leaves out U+001C to U+001F.
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


class Codec:
    """Encoder and decoder for one vocabulary of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.symbols = {rank: piece for piece, rank in ranks.items()}
        self.pretokens = regex.compile(pattern)
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    @classmethod
    @functools.cache
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        get = ranks.get
        size = len(piece)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        current = [get(piece[at : at + 2], -1) for at in range(size - 1)]  # the rank of the pair that starts here
        current.append(-1)
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}  # a bit for each rank with a bucket
        top = 0  # a bit for each word that isn't zero

        def push(rank: int, at: int) -> None:
            nonlocal top
            if rank in buckets:
                heapq.heappush(buckets[rank], at)
                return
            buckets[rank] = [at]
            high = rank >> LEVEL_BITS
            words[high] = words.get(high, 0) | 1 << (rank & LEVEL_MASK)
            top |= 1 << high

        for at, rank in enumerate(current):
            if rank >= 0:
                push(rank, at)
        while top:
            first = top & -top
            high = first.bit_length() - 1
            word = words[high]
            bit = word & -word
            rank = high << LEVEL_BITS | bit.bit_length() - 1
            bucket = buckets[rank]
            at = heapq.heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[high] = word = word ^ bit
                if not word:
                    top ^= first
            if current[at] != rank:
                continue  # stale
            gone = after[at]
            after[at] = end = after[gone]
            current[gone] = current[at] = -1
            if end < size:
                before[end] = at
                wider = get(piece[at : after[end]])
                if wider is not None:
                    current[at] = wider
                    push(wider, at)
            left = before[at]
            if left >= 0:
                current[left] = -1
                wider = get(piece[left:end])
                if wider is not None:
                    current[left] = wider
                    push(wider, left)
        ids, at = [], 0
        while at < size:
            ids.append(ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def _piece(self, piece: str) -> bytes:
        packed = array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= CACHE_KEY:
            if len(self._pieces) >= CACHE_ENTRIES:
                self._pieces.clear()
            self._pieces[piece] = packed
        return packed

    def _chunk(self, chunk: str) -> bytes:
        known = self._pieces.get
        packed = b"".join([known(piece) or self._piece(piece) for piece in self.pretokens.findall(chunk)])
        if len(chunk) <= CACHE_KEY:
            if len(self._chunks) >= CACHE_ENTRIES:
                self._chunks.clear()
            self._chunks[chunk] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit numbers in the machine's order.

        White space after anything else always starts a pre-token, so a run
        of white space with what follows is cut into pre-tokens on its own.
        """
        known = self._chunks.get
        return b"".join([known(chunk) or self._chunk(chunk) for chunk in _CHUNK.findall(text or "")])

    def decode(self, packed: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.symbols.__getitem__, memoryview(packed).cast("I")))


def _codec(path: str | None, pattern: str | None) -> Codec:
    return Codec.load(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids``: array<int>, empty for a null or empty text."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path, pattern)
        for texts in batches:
            yield pd.Series([memoryview(codec.encode(t)).cast("i").tolist() for t in texts], dtype=object)

    return docs.withColumn("ids", of(F.col(text)))


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``tokens`` with a column ``decoded``: the binary that array<int> ``ids`` stands for."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path, None)
        for lists in batches:
            yield pd.Series([codec.decode(array("I", () if x is None else x).tobytes()) for x in lists], dtype=object)

    return tokens.withColumn("decoded", of(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                back = codec.decode(ids)
                small = ids if array("H", [1]).tobytes()[0] else array("I", ids).byteswap().tobytes()
                found.append((len(ids) // 4, hashlib.sha256(small).hexdigest(), hashlib.sha256(back).hexdigest()))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            arrays = [pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, the hash of its ids and the hash of the decoded bytes."""
    return digests(table(spark, sf_dir, "documents"))
