"""A bitmap of 64-bit codes of one fixed size, put together by Spark: a filter
that lets some others through, and more of them the more codes it holds, but
never loses one. What passes is decided by an exact join."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26  # of a place: 8 MB
BLOCK = 1 << 15  # bits in a block of Spark's bitmap functions


def bitmap(codes: DataFrame, sc: SparkContext) -> Broadcast:
    """The bitmap of a frame's one long column, broadcast: two places for each code."""
    name, low = codes.columns[0], (1 << BITS) - 1
    pair = F.array(F.col(name).bitwiseAND(low) + 1, F.shiftrightunsigned(name, 32).bitwiseAND(low) + 1)
    place = codes.select(F.explode(pair).alias("p"))
    blocks = place.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in blocks.collect():  # at most 2^26 / 2^15 blocks of 4 KB
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["k"] - 1) * BLOCK // 8 :][: len(part)] = part
    return sc.broadcast(out)


def lookup(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << BITS) - 1)
    a, b = ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in (codes & low, (codes >> np.uint64(32)) & low))
    return (a & b).astype(bool)
