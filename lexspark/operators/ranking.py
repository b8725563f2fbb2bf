"""Ranks and caps, the sequential rules restated over sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.storage import stored


def capped(rows: DataFrame, head: str, cap: int, order: list[Column], taken: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """At most ``cap`` rows a head, the first in order; rows outside ``where`` are not counted and stay.

    ``taken(head, n)`` are slots that are occupied already.
    """
    where = F.lit(True) if where is None else where
    held = rows.withColumn("_capped", where)
    if taken is not None:
        held = held.join(taken.select(F.col(head), F.col("n").alias("_taken")), head, "left")
    else:
        held = held.withColumn("_taken", F.lit(0))
    place = F.row_number().over(Window.partitionBy("_capped", head).orderBy(*order))
    free = F.greatest(F.lit(cap) - F.coalesce("_taken", F.lit(0)), F.lit(0))
    return held.withColumn("_place", place).where(~F.col("_capped") | (F.col("_place") <= free)).drop("_capped", "_taken", "_place")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Rows with their place in one order over all, from ``start``. In two levels, so that no task sorts everything.

    Rows are dealt into ranges of the order; a row's rank is its place in its range and the rows
    of the ranges before. Ranges are counted, not collected.
    """
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    dealt = rows.withColumn("_key", key).repartitionByRange("_key").withColumn("_part", F.spark_partition_id())
    return _numbered(dealt, name, start)


def _numbered(dealt: DataFrame, name: str, start: int) -> DataFrame:
    dealt = stored(dealt)  # ranges are sampled; written, they are the same for both uses
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + place + (start - 1)).cast("long")).drop("_part", "_start", "_key")


def interleaved(words: DataFrame, phrases: DataFrame, share: float, place: str = "place") -> DataFrame:
    """Two ranked lists in one order, ``share`` of it words; each keeps its order and words come first on a tie.

    ``place`` is the 0-based place in its list. Without words, or at a share of 0, there are phrases
    only; without phrases, or at 1, words only. Adds ``slot`` and ``is_phrase``, which sort the result.
    """
    share = min(max(share, 0.0), 1.0)
    w, p = words.withColumn("is_phrase", F.lit(0)), phrases.withColumn("is_phrase", F.lit(1))
    if share <= 0.0 or words.isEmpty():
        return p.withColumn("slot", F.col(place).cast("double"))
    if share >= 1.0 or phrases.isEmpty():
        return w.withColumn("slot", F.col(place).cast("double"))
    return w.withColumn("slot", F.col(place) / share).unionByName(p.withColumn("slot", F.col(place) / (1.0 - share)))


def pushed_back(units: DataFrame, movable: Column, top: int) -> DataFrame:
    """Movable units among the first that fill ``top`` places with others, moved to just behind those.

    The stretch goes from the first moved unit to the ``top``-th other one; its units are numbered
    anew with the ranks it had, the others first, both in their order. All other ranks stay.
    """
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    held = units.withColumn("_m", movable.cast("int"))
    held = held.withColumn("_others", F.coalesce(F.sum(1 - F.col("_m")).over(by_rank), F.lit(0))).withColumn("_moved", F.coalesce(F.sum("_m").over(by_rank), F.lit(0)) + F.col("_m"))
    inside = (F.col("_others") < top) & (F.col("_moved") > 0)
    held = held.withColumn("_in", inside)
    old = F.row_number().over(Window.partitionBy("_in").orderBy("rank"))
    new = F.row_number().over(Window.partitionBy("_in").orderBy("_m", "rank"))
    held = held.withColumn("_old", old).withColumn("_new", new)
    ranks = held.where("_in").select(F.col("_old").alias("_new"), F.col("rank").alias("_rank"))
    moved = held.where("_in").join(ranks, "_new").withColumn("rank", F.col("_rank"))
    return moved.select(units.columns).unionByName(held.where("not _in").select(units.columns))
