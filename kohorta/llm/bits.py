"""Membership filter of fixed size, filled by Spark and broadcast.

A key (a 64-bit hash) sets the bit that its highest bits name. A key whose bit is not set
is not in the table; one whose bit is set may be. Size and what reaches the driver follow
``BITS`` alone; where a table outgrows it, more keys pass and are dropped by later joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27


def filter_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of all values of ``column`` as an array of ``2**(BITS - 6)`` words."""
    slot = F.shiftrightunsigned(F.col(column), 64 - BITS)
    rows = (
        keys.select(F.shiftright(slot, 6).cast("int").alias("at"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
        .groupBy("at")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word"))
        .toArrow()
    )
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the table."""
    slot = keys.astype(np.uint64) >> np.uint64(64 - BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
