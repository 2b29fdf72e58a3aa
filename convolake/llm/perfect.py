"""A minimal perfect hash of 64-bit keys, with the keys stored at their slots.

Level by level every key that is still left is thrown into an array of
``ROOM`` times as many places; where it lies alone its place is set, and the
others go on to the next level.  A key's slot is the number of set places
before its own over all levels, so n keys have the slots 0 to n - 1.  A number
that isn't a key may land on a slot, too, which the stored key tells.
"""

from __future__ import annotations

import struct

import numpy as np

from convolake.llm.words import mixed

ROOM = 2
LEAST = 64
_TURN = 0xA0761D6478BD642F


def _places(x: np.ndarray, level: int, size: int) -> np.ndarray:
    turned = mixed(x ^ np.uint64((level + 1) * _TURN & ((1 << 64) - 1)))
    return ((turned >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots of a fixed set of keys."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray) -> None:
        self.levels, self.keys = levels, keys
        firsts = np.cumsum([0] + [int(x.sum()) for x in levels])
        self._ranks = [first + np.cumsum(x, dtype=np.int64) - 1 for first, x in zip(firsts, levels, strict=False)]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct unsigned 64-bit keys, fewer than 2 to the 31."""
        left, levels = keys, []
        while len(left):
            if len(levels) > 64:
                raise ValueError("keys repeat")
            size = max(LEAST, ROOM * len(left))
            at = _places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        made = cls(levels, keys)
        stored = np.empty(len(keys), np.uint64)
        stored[made._found(keys)] = keys
        return cls(levels, stored)

    def _found(self, x: np.ndarray) -> np.ndarray:
        out, left = np.full(len(x), -1, np.int64), np.arange(len(x))
        for level, (alone, ranks) in enumerate(zip(self.levels, self._ranks, strict=True)):
            at = _places(x[left], level, len(alone))
            here = alone[at]
            out[left[here]] = ranks[at[here]]
            left = left[~here]
        return out

    def slots(self, x: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for what isn't one."""
        out = self._found(x)
        if len(self.keys):
            out[self.keys[np.maximum(out, 0)] != x] = -1
        return out

    def pack(self) -> bytes:
        sizes = struct.pack(f"<I{len(self.levels)}I", len(self.levels), *map(len, self.levels))
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.keys.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        n = struct.unpack_from("<I", raw)[0]
        at, levels = 4 + 4 * n, []
        for size in struct.unpack_from(f"<{n}I", raw, 4):
            upto = at + (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw[at:upto], np.uint8), count=size).astype(bool))
            at = upto
        return cls(levels, np.frombuffer(raw[at:], "<u8"))
