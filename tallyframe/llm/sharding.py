"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get a global number by a total order, so the numbering does not depend on files,
partitions or earlier runs. A keyed Feistel network permutes 0..N-1: it is a bijection of
the next even power of two of bits, and a value that lands at N or beyond is walked along
its cycle until it is below N (fewer than four steps on average). The place gives shard
(``place % shards``) and slot (``place // shards``): both can be computed for any row number
without a table, slots have no gaps, and shard counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.order import running

ROUNDS = 6


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of the row numbers ``x`` in 0..n-1 under the permutation of ``seed``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xC2B2AE3D27D4EB4F) % (1 << 64)) for i in range(ROUNDS)]

    def network(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        return (left << np.uint64(half)) | right

    out = network(x.astype(np.uint64))
    while len(walk := np.flatnonzero(out >= np.uint64(n))):
        out[walk] = network(out[walk])
    return out.astype(np.int64)


def shard(df: DataFrame, order: list[Column], shards: int, seed: int = 0) -> DataFrame:
    """``df`` plus ``shard`` (int) and ``slot`` (long).

    ``order`` must make rows comparable; rows equal in it may swap places. An empty table
    gives an empty result. Columns of ``df`` named ``shard`` or ``slot`` are replaced."""
    df = df.drop("shard", "slot", "_one", "_row", "_n")
    rows = running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_row", total="_n").drop("_one")
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("_row", "_n")]
                          + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            n = b.column("_n")[0].as_py()
            at = permute(b.column("_row").to_numpy(zero_copy_only=False), n, seed)
            names = [c for c in b.schema.names if c not in ("_row", "_n")]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array((at % shards).astype(np.int32)), pa.array(at // shards)],
                names + ["shard", "slot"])

    return rows.mapInArrow(place, schema)
