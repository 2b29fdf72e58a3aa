"""A Bloom filter of two bits a number and at most 32 MB, built by Spark and broadcast."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each number in it, up to 32 MB in all; a fuller one lets more through, and never less.
BITS_EACH = 16
LEAST, MOST = 1 << 16, 1 << 28
_PART = 8192
#: Where the two bits are taken from a number; its lowest bits may be the same in all.
_FROM = (3, 35)


def held(numbers: DataFrame, column: str) -> bytes:
    """The filter of a long column of hashes, which need no further hashing; nulls are left out."""
    some = numbers.select(F.col(column).alias("x")).dropna().distinct()
    wanted = 1 << (BITS_EACH * max(1, some.count())).bit_length()
    bits = min(max(wanted, LEAST), MOST)
    each = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("x", at), F.lit(bits)) for at in _FROM]))
    words = some.select(each.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits"))

    def packed(found: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(_PART // 8, np.int64)
        part[found["word"].to_numpy(np.int64) % len(part)] = found["bits"].to_numpy(np.int64)
        return pd.DataFrame({"part": [int(found["word"].iloc[0]) // len(part)], "held": [part.tobytes()]})

    parts = words.groupBy(F.shiftright("word", 10)).applyInPandas(packed, "part int, held binary")
    whole = bytearray(bits // 8)
    for r in parts.toLocalIterator():  # 4,096 rows of 8 KB at most
        whole[r["part"] * _PART : (r["part"] + 1) * _PART] = r["held"]
    return bytes(whole)


def may_hold(filter_: bytes, x: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned or signed 64-bit numbers may be in the filter."""
    table, out = np.frombuffer(filter_, np.uint8), np.ones(len(x), bool)
    for at in _FROM:
        bit = (x.view(np.uint64) >> np.uint64(at)) & np.uint64(8 * len(table) - 1)
        out &= (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out
