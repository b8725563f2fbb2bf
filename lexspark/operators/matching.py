"""Lookups with fallbacks, rivals, curated groups, derivations and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X


def matched_by_probes(words: DataFrame, units: DataFrame, probes: list[tuple[str, Column, Column]]) -> DataFrame:
    """``(word, probe, unit_id, rank)``: for each word the first probe that hits, there the unit of least rank.

    A probe is a name, a key of words and a key of units (arrays are exploded). All are equi-joins.
    """
    found = []
    for place, (name, word_key, unit_key) in enumerate(probes):
        many = lambda df, key: F.explode(key) if dict(df.select(key.alias("k")).dtypes)["k"].startswith("array") else key
        a = words.select("word", many(words, word_key).alias("k"))
        b = units.select("unit_id", "rank", many(units, unit_key).alias("k"))
        found.append(a.join(b, "k").groupBy("word").agg(F.min(F.struct("rank", "unit_id")).alias("u")).select("word", F.struct(F.lit(place).alias("p"), F.lit(name).alias("probe"), "u.rank", "u.unit_id").alias("hit")))
    best = reduce(DataFrame.union, found).groupBy("word").agg(F.min("hit").alias("hit"))
    return words.select("word").distinct().join(best, "word", "left").select("word", "hit.probe", "hit.unit_id", "hit.rank")


def rivals(units: DataFrame, least: int = 2, most: int = 12, k: int = 10) -> DataFrame:
    """``(unit_id, rival)``: units that share a sense and a class with a unit, but not its head.

    Groups beyond ``most`` are senses too common to confuse anybody and have no rivals; that is the rule, so a
    group's pairs are at most ``most`` squared.
    """
    senses = units.select("unit_id", "kind", "head", "rank", F.explode(F.array_distinct(X.gloss_senses(F.col("gloss")))).alias("sense"))
    sized = senses.groupBy("kind", "sense").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    held = senses.join(sized.select("kind", "sense"), ["kind", "sense"])
    other = held.select("kind", "sense", F.col("unit_id").alias("rival"), F.col("head").alias("rival_head"), F.col("rank").alias("rival_rank"))
    pairs = held.join(other, ["kind", "sense"]).where("unit_id <> rival and head <> rival_head").select("unit_id", "rival", "rival_rank").distinct()
    place = F.row_number().over(Window.partitionBy("unit_id").orderBy("rival_rank", "rival"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select("unit_id", "rival", "place")


def group_members(groups: DataFrame, units: DataFrame) -> DataFrame:
    """``(key, other, unit_id)``: for ``groups(id, keys)`` each member with each other one; one that is no unit stays a bare word."""
    each = groups.select("id", F.explode("keys").alias("key"))
    others = each.withColumnRenamed("key", "other")
    pairs = each.join(others, "id").where("key <> other").select("key", "other").distinct()
    return pairs.join(units.select(F.col("lemma_key").alias("other"), "unit_id"), "other", "left").select("key", "other", "unit_id")


def prefix_extensions(keys: DataFrame) -> DataFrame:
    """``(key, longer)``: keys that another one extends by words, found by equality with its prefixes."""
    words = F.split("key", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    longer = keys.where(F.size(words) > 1).select(F.col("key").alias("longer"), F.explode(prefixes).alias("key"))
    return keys.join(longer, "key").select("key", "longer").distinct()


def suffix_bases(words: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """``(word, prefix, base)``: words that are another one behind a prefix of ``least`` to ``most`` letters, the longest base first."""
    cuts = F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.struct(F.substr("word", F.lit(1), k).alias("prefix"), F.substr("word", k + 1).alias("base")))
    each = words.select("word", F.explode(cuts).alias("c")).select("word", "c.prefix", "c.base").where(F.length("base") >= least)
    held = each.join(words.select(F.col("word").alias("base")), "base")
    return held.groupBy("word").agg(F.max_by(F.struct("prefix", "base"), F.length("base")).alias("b")).select("word", "b.prefix", "b.base")


def candidate_hits(occurrences: DataFrame, units: DataFrame) -> DataFrame:
    """``(occ, unit_id, place)``: the first of an occurrence's candidate ids that is a unit."""
    each = occurrences.select("occ", F.posexplode("candidates").alias("place", "unit_id"))
    held = each.join(units.select("unit_id"), "unit_id")
    return held.groupBy("occ").agg(F.min(F.struct("place", "unit_id")).alias("m")).select("occ", "m.unit_id", "m.place")


def without_excluded(units: DataFrame, excluded: DataFrame) -> DataFrame:
    """Units that are excluded neither by key nor by kind and key."""
    keys = units.withColumn("_full", F.concat_ws(":", "kind", "key"))
    gone = excluded.select(F.col("entry")).distinct()
    left = keys.join(gone.withColumnRenamed("entry", "key"), "key", "left_anti")
    return left.join(gone.withColumnRenamed("entry", "_full"), "_full", "left_anti").drop("_full")
