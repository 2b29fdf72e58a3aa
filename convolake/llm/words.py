"""Words of many texts at once, each with a 64-bit hash of its bytes.

Texts are UTF-8 bytes, laid side by side with a newline between them, so a
table of 256 flags finds all words of a slice.  A word's hash is a difference
of running sums over powers of an odd number, and costs no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked at together, if a text isn't longer, and bytes whose running sums are held at a time.
SLICE = 1 << 20
_RNG = np.random.default_rng(29)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_UP = 0x9E3779B97F4A7C15
_DOWN = pow(_UP, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_held: list[np.ndarray] = []


class Words(NamedTuple):
    """``data`` holds the lower-cased texts; word k is data[starts[k]:ends[k]] of text doc[k]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers with their bits stirred, one to one."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(32))


def flags(outside: bytes) -> np.ndarray:
    """A table of 256 flags, false for the bytes of ``outside``."""
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


def _powers(n: int) -> list[np.ndarray]:
    if not _held or len(_held[0]) < n:
        both = []
        for base in (_UP, _DOWN):
            factors = np.full(max(n, SLICE), base, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors))
        if n > SLICE:
            return both
        _held[:] = both
    return _held


def found(texts: list[bytes], inside: np.ndarray) -> Words:
    """The words of ``texts``: runs of bytes that ``inside`` flags, A-Z as a-z."""
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    held = np.zeros(len(data) + 2, bool)
    held[1:-1] = inside[data]
    edges = np.flatnonzero(held[1:] != held[:-1])
    starts, ends = edges[::2], edges[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
        part = data[lo : ends[upto - 1]]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
        s, e = starts[at:upto] - lo, ends[at:upto] - lo
        hashes[at:upto] = (sums[e] - sums[s]) * down[s]
        at = upto
    return Words(data, starts, ends, np.searchsorted(begins, starts, "right") - 1, mixed(hashes))


def slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of a column of strings, as UTF-8 bytes, null as empty.

    A slice has ``SLICE`` bytes or, if it is longer, one text; only one is held at a time.
    """
    raw = column.cast(pa.binary())
    ends = np.cumsum(np.nan_to_num(pc.binary_length(raw).to_numpy(zero_copy_only=False)).astype(np.int64) + 1)
    first, begun = 0, 0
    while first < len(raw):
        upto = max(first + 1, int(np.searchsorted(ends, begun + SLICE, "right")))
        yield first, [x or b"" for x in raw.slice(first, upto - first).to_pylist()]
        first, begun = upto, int(ends[upto - 1])
