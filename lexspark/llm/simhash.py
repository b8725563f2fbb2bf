"""SimHash near-dedup: fingerprints, a grid range-join of their segment popcounts, and components.

A fingerprint is cut into segments of two bits. Its embedding has one coordinate a segment, the
number of set bits; the Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints. The coordinates are kept as thermometer codes (0, 1, 2 set bits: 00, 01, 11), so that
the Manhattan distance of two embeddings is ``bit_count`` of their XOR and stays one expression.

For distance d the coordinates are cut into d // 2 + 1 blocks: two near embeddings differ by at most
one step in some block. Each fingerprint goes into the grid cell of each block, and looks into that
cell and those one step up (the other one of a pair looks from below), which makes an equi-join.
Pairs that the Manhattan bound leaves are verified on the whole fingerprints in the join condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.common import set_aside, stored, table
from lexspark.llm.components import connected_components

_LOW = 0x5555555555555555
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUN = 65_536  # shingles whose bits are counted at once


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text, as a signed number; 0 without a word.

    The majority is taken over all shingles, repeats included; a tie leaves the bit unset.
    """
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[words - 1 :] if len(w) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, _RUN):
        h = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + _RUN].tolist(), last[at : at + _RUN].tolist())]
        bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; a null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Set bits of each two-bit segment, as thermometer codes in the segment's place."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(n: int) -> list[tuple[int, int]]:
    """First and last-but-one segment of each block of the 32 segments."""
    cuts = [round(32 * i / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def near_pairs(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of the distinct values of ``fps.fp`` at ``max_distance`` or fewer differing bits."""
    points = fps.select("fp").where("fp is not null").distinct().withColumn("e", embedding(F.col("fp")))
    cells, looks = [], []
    for i, (a, b) in enumerate(_blocks(max_distance // 2 + 1)):
        mask = F.lit(_signed(sum(3 << 2 * j for j in range(a, b))))
        cell = F.col("e").bitwiseAND(mask)
        cells.append(F.struct(F.lit(i).alias("block"), cell.alias("cell")))
        up = []
        for j in range(a, b):
            low, high = F.lit(_signed(1 << 2 * j)), F.lit(_signed(2 << 2 * j))
            up.append(F.when(F.col("e").bitwiseAND(low) == 0, cell.bitwiseOR(low)).when(F.col("e").bitwiseAND(high) == 0, cell.bitwiseOR(high)))
        looks += [F.struct(F.lit(i).alias("block"), c.alias("cell")) for c in (cell, *up)]
    held = points.select("fp", "e", F.explode(F.array(*cells)).alias("k")).select(F.col("fp").alias("fp_b"), F.col("e").alias("e_b"), "k.block", "k.cell")
    sought = points.select("fp", "e", F.explode(F.array(*looks)).alias("k")).select("fp", "e", "k.block", "k.cell").where("cell is not null")
    near = (
        (sought["block"] == held["block"])
        & (sought["cell"] == held["cell"])
        & (F.bit_count(sought["e"].bitwiseXOR(held["e_b"])) <= max_distance)
        & (F.bit_count(sought["fp"].bitwiseXOR(held["fp_b"])) <= max_distance)
        & (sought["fp"] != held["fp_b"])
    )
    return sought.join(held, near).select(F.least("fp", "fp_b").alias("u"), F.greatest("fp", "fp_b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_distance: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Documents with equal fingerprints are one point of the join, so copies are never expanded into
    pairs. ``component_id`` is the smallest doc_id that links reach. Null and empty texts have
    fingerprint 0, linked like any other. Repeated rows get the same component; a null doc_id takes
    part but is never a component's id unless all ids in it are null. No rows: no rows. Columns other
    than the two named ones are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    roots = connected_components(near_pairs(fps, max_distance))
    points = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id, all columns kept.

    Rows that share a doc_id are one document, of which one row stays (the choice is by a hash of
    the row). Rows without a doc_id cannot be told apart by the result and all stay. Columns keep their names, whatever these are.
    """
    docs, back = set_aside(docs, ("_row", "fp", "component_id"))
    kept = near_duplicates(docs, words=words, max_distance=max_distance).where("doc_id = component_id")
    named = docs.where("doc_id is not null").join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    one = named.withColumn("_row", F.row_number().over(first)).where("_row = 1").select(docs.columns)
    return one.unionByName(docs.where("doc_id is null")).withColumnsRenamed(back)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, max_distance=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
