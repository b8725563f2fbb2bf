"""The deck as files: shards by rank and by letter, a manifest, its hash, and checks of its integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X

SHARD = 200


def content_hash(df: DataFrame) -> DataFrame:
    """``(hash, rows)``: twelve hex digits that depend on a table's rows, not on their order.

    Rows are digested where they are; digests are gathered by their first four hex digits and each of
    those 65,536 buckets is digested in turn, so that no task gathers the table.
    """
    row = df.select(F.sha1(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("d"))
    salted = row.groupBy(F.substring("d", 1, 4).alias("b")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("d")), "")).alias("d"), F.count("*").alias("n"))
    total = salted.agg(F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")), 1, 12).alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return total


def shard_of(rank: Column, size: int = SHARD) -> Column:
    return F.floor((rank - 1) / size).cast("long")


def export(cards: DataFrame, units: DataFrame, path: str) -> None:
    """Write cards by rank band and units by letter, as JSON; refuse cards without a unit."""
    orphans = cards.join(units, "unit_id", "left_anti")
    if not orphans.isEmpty():
        raise ValueError("cards without a unit")
    placed = cards.join(units.select("unit_id", "rank"), "unit_id").withColumn("band", shard_of(F.col("rank")))
    placed.repartitionByRange("band", "rank").sortWithinPartitions("band", "rank", "card_id").write.mode("overwrite").partitionBy("band").json(f"{path}/cards")
    units.withColumn("letter", X.reserve_letter(F.col("lemma_key"))).repartitionByRange("letter", "rank").sortWithinPartitions("letter", "rank").write.mode("overwrite").partitionBy("letter").json(f"{path}/units")
    content_hash(cards).write.mode("overwrite").json(f"{path}/manifest")


def problems(units: DataFrame, cards: DataFrame) -> DataFrame:
    """``(problem, id)`` of a deck: orphans, wrong counts, repeated ids and ranks, glosses that give the answer away."""
    orphan = cards.join(units, "unit_id", "left_anti").select(F.lit("orphan card").alias("problem"), F.col("card_id").alias("id"))
    counts = cards.groupBy("unit_id").agg(F.count("*").alias("n"))
    held = units.join(counts, "unit_id", "left")
    wrong = held.where(F.coalesce("n", F.lit(0)) != F.col("card_count")).select(F.lit("card count"), "unit_id")
    again = cards.groupBy("card_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated card"), "card_id")
    ranks = units.groupBy("rank").agg(F.count("*").alias("n"), F.min("unit_id").alias("unit_id")).where("n > 1").select(F.lit("repeated rank"), "unit_id")
    leak = cards.where("gloss is not null and contains(lower(gloss), lower(answer))").select(F.lit("gloss leak"), "card_id")
    return orphan.union(wrong).union(again).union(ranks).union(leak)
