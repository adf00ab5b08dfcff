"""A fixed-size set filter that tells what is certainly not in a distributed set of hashes."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Members:
    """One bit per slot; ``holds`` never misses a member and may report others."""

    bits: int
    table: np.ndarray

    def __getstate__(self):
        # a sparse table travels small
        return self.bits, zlib.compress(self.table.tobytes(), 1)

    def __setstate__(self, state):
        object.__setattr__(self, "bits", state[0])
        object.__setattr__(self, "table", np.frombuffer(zlib.decompress(state[1]), np.uint64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        word = self.table[(slot >> np.uint64(6)).astype(np.int64)]
        return (word >> (slot & np.uint64(63))) & np.uint64(1) != 0


def members(hashes: DataFrame, column: str, bits: int = 27) -> Members:
    """Set the bit of every 64-bit hash. Spark ORs the words together: at most 2**(bits - 6) rows come to
    the driver and 2**(bits - 3) bytes are broadcast, whatever the size of the set. Nulls are left out."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    words = (
        hashes.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("value"))
    )
    got = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("word").to_numpy()] = got.column("value").to_numpy().astype(np.uint64)
    return Members(bits, table)
