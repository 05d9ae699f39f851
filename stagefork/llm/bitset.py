"""A filter of fixed size over the longs of a column, for use in tasks.

It has false positives and no false negatives, so it only spares rows that a join
removes anyway; its size doesn't follow the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bits of a filter; it takes 4 MB.
BITS = 1 << 25


def bitset(values: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Words of 64 bits; at most bits / 64 rows come to the driver."""
    place = F.pmod(F.col(column), F.lit(bits))
    words = values.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def in_bitset(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values % np.int64(len(words) * 64)
    return (words[place >> 6] >> (place & 63)) & 1 == 1
