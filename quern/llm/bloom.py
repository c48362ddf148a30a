"""A Bloom filter of fixed largest size over a column of 64-bit hashes: it only spares work, so a full one costs time, not rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits at most: what is broadcast never exceeds 32 MB.
MOST_BITS = 1 << 28


class Bloom:
    def __init__(self, bits: np.ndarray, m: int):
        self.bits, self.m = bits, m

    def __contains__(self, h: np.ndarray):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        """For unsigned 64-bit hashes, which may be in the filter."""
        if not self.m:
            return np.zeros(len(h), bool)
        ok = np.ones(len(h), bool)
        for p in (h & np.uint64(self.m - 1), (h >> np.uint64(32)) & np.uint64(self.m - 1)):
            ok &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def build(hashes: DataFrame, column: str) -> Bloom:
    """The filter of a column (long), as 64-bit words that are put together before they are shuffled; at most MOST_BITS / 64 words come to the driver."""
    n = hashes.count()
    if not n:
        return Bloom(np.zeros(0, np.uint8), 0)
    m = min(MOST_BITS, max(1 << 12, 1 << (16 * n - 1).bit_length()))
    h = F.col(column)
    places = F.array(h.bitwiseAND(F.lit(m - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(m - 1)))
    place = F.col("place")
    words = hashes.select(F.explode(places).alias("place")).groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(m // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return Bloom(out.view(np.uint8), m)
