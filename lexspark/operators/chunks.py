"""Consecutive rows in chunks that start anew when a size or a count is reached, without one task for all rows.

Where a chunk ends hangs on where it began, so chunks cannot be cut by sums alone. Rows are dealt into blocks of a fixed number of rows, each with as many
rows of the next block as a chunk can have. A block tells for each place at which a chunk may enter it where the first chunk of the next block begins.
These tables are composed by doubling: after k rounds they lead over 2^k blocks, so the entry of every block is known
after as many joins as the number of blocks has binary digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators.ranking import ranked
from lexspark.storage import stored

#: Rows of a block; at least as many as a chunk can have.
BLOCK = 65_536


def _next(sizes: np.ndarray, most: int, count: int) -> np.ndarray:
    """For each row the first row of the chunk after one that begins there: full by size or by count, one row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    before = ends - sizes
    after = np.searchsorted(ends, before + most, side="right")
    at = np.arange(len(sizes))
    return np.minimum(np.maximum(after, at + 1), at + count)


def chunked(rows: DataFrame, size: Column, order: list[Column], most: int, count: int, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``chunk``, from 0: a row goes into the chunk of the row before unless that is then larger than ``most`` or has ``count`` rows.

    A row larger than ``most`` is a chunk of its own. ``order`` must tell all rows apart. Sizes that are null count as 0. No rows: no rows.
    """
    if count < 1 or block < count:
        raise ValueError("a block must hold a chunk")
    held = stored(ranked(rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))), order, "_at", 0).withColumn("_block", F.floor(F.col("_at") / block).cast("long")))
    own = held.select("_block", "_at", "_size")
    ahead = own.where((F.col("_block") > 0) & (F.col("_at") % block < count)).withColumn("_block", F.col("_block") - 1)
    seen = own.unionByName(ahead)

    def passage(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        after, n = _next(np.asarray(t["_size"]), most, count), min(block, len(t))
        leave = np.arange(len(after) + count)
        for i in range(n - 1, -1, -1):
            leave[i] = leave[after[i]] if after[i] < n else after[i]
        entries = np.arange(min(count, n))
        return pa.table({"block": pa.array(np.full(len(entries), key[0].as_py())), "entry": pa.array(entries), "to": pa.array(np.full(len(entries), key[0].as_py() + 1)), "leaves": pa.array(leave[entries] - n)})

    jump = stored(seen.groupBy("_block").applyInArrow(passage, "block long, entry long, to long, leaves long"))
    blocks = (held.agg(F.max("_block")).first()[0] or 0) + 1
    known = held.sparkSession.createDataFrame([(0, 0)], "block long, entry long")
    for _ in range(max(blocks - 1, 0).bit_length()):
        reached = known.join(jump, ["block", "entry"]).select(F.col("to").alias("block"), F.col("leaves").alias("entry"))
        known = stored(known.union(reached).distinct())
        onward = jump.select(F.col("block").alias("to"), F.col("entry").alias("leaves"), F.col("to").alias("_to"), F.col("leaves").alias("_leaves"))
        jump = stored(jump.join(onward, ["to", "leaves"]).select("block", "entry", F.col("_to").alias("to"), F.col("_leaves").alias("leaves")))

    def starts(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        after, n, at = _next(np.asarray(t["_size"]), most, count), min(block, len(t)), t["entry"][0].as_py()
        first = np.zeros(n, np.int64)
        while at < n:
            first[at] = 1
            at = after[at]
        return pa.table({"_at": t["_at"].slice(0, n), "block": pa.array(np.full(n, key[0].as_py())), "local": pa.array(np.cumsum(first))})

    entered = seen.join(known.select(F.col("block").alias("_block"), "entry"), "_block")
    numbered = stored(entered.groupBy("_block").applyInArrow(starts, "_at long, block long, local long"))
    totals = numbered.groupBy("block").agg(F.max("local").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    placed = numbered.join(totals.select("block", before.alias("before")), "block").select("_at", (F.col("before") + F.col("local") - 1).alias("chunk"))
    return held.join(placed, "_at").drop("_at", "_size", "_block")
