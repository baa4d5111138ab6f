"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers in key order.  A balanced Feistel network
permutes the next power of four; numbers that fall outside the table walk their
cycle until they are inside, which gives a permutation of exactly the table's
numbers.  Permuted number p lies in shard ``p mod shards`` at slot
``p div shards``, so shard and slot of any row, and the row of any shard and
slot, can be computed without a lookup.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import checkpoint, prepare


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class FeistelPermutation:
    """A keyed permutation of the integers 0 to n - 1, for whole arrays."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n, self.half = n, max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = _mix(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ (_mix(right + k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (_mix(left + k) & self.mask), left
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x).astype(np.uint64))
        while (far := np.flatnonzero(out >= self.n)).size:
            out[far] = step(out[far])
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._back)

    def locate(self, row: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, slot) of row numbers."""
        p = self.forward(row)
        return p % shards, p // shards

    def row_at(self, shard: np.ndarray, slot: np.ndarray, shards: int) -> np.ndarray:
        """The row number held at a shard and slot."""
        return self.inverse(np.asarray(slot) * shards + np.asarray(shard))


def number_rows(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """(df with gapless global numbers from 0 in the order of keys, the number of rows).

    Sorted by range partitions, so no task sees more than its share; a last key
    splits a run of equal rows, which are interchangeable.  Only one count for
    each partition comes to the driver.  The numbered rows are checkpointed:
    a lost executor cannot renumber them.  Nulls sort first.
    """
    tie = "__tie"
    sort = [*keys, tie]
    ordered = df.withColumn(tie, F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*sort).sortWithinPartitions(*sort).drop(tie)
    local = checkpoint(ordered.withColumn("__local", F.monotonically_increasing_id()))
    part = F.shiftright("__local", 33)
    counts = sorted(local.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    # One row for each partition of the sort: as small as the plan itself.
    offset = local.sparkSession.createDataFrame(offsets, "__part long, __offset long")
    joined = local.join(F.broadcast(offset), part == F.col("__part"))
    number = F.col("__local").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__offset")
    return joined.select(*df.columns, number.alias(name)), total


def shard_rows(df: DataFrame, keys: list[str], shards: int, key: int) -> DataFrame:
    """df with columns row_number, shard and slot.

    Shards differ by at most one row; slots are gapless from 0 in each shard.
    The same table, keys, shard count and permutation key give the same result
    whatever the partitioning.  Repeated rows each get a place of their own,
    null keys sort first, an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    prepare(df.sparkSession, 10_000)
    numbered, n = number_rows(df, keys)
    perm = FeistelPermutation(n, key)

    @F.pandas_udf("shard int, slot long")
    def place(row: pd.Series) -> pd.DataFrame:
        shard, slot = perm.locate(row.to_numpy(), shards)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return numbered.withColumn("__at", place("row_number")).select(*df.columns, "row_number", "__at.shard", "__at.slot")
