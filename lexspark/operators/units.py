"""Units from occurrences: the tally of each unit and the decision on it, with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import statistics as S


# Limits that decisions on units must share to come out alike (survey M1 to M12).
@dataclass(frozen=True)
class Thresholds:
    """Limits of the rules; the defaults are those of a corpus of some million sentences."""

    count: int = 5
    governed_ratio: float = 0.05
    governed_lift: float = 3.0
    reflexive_share: float = 0.3
    reflexive_with_preposition: float = 0.6
    pair_g2: float = 15.13
    pair_lift: float = 5.0
    pair_lemma: int = 20
    pair_everyday: int = 3
    adjective_count: int = 40
    adjective_lift: float = 25.0
    adverb_count: int = 8
    adverb_lift: float = 8.0
    adverb_use: int = 50
    carriers: int = 3
    word_count: int = 100
    case_share: float = 0.75
    trivial_rank: int = 300


def first_in_sentence(occurrences: DataFrame) -> DataFrame:
    """One row for each unit and sentence, its first occurrence there. The least of a struct, so repeats go before the shuffle."""
    names = [c for c in occurrences.columns if c not in {"kind", "key", "sentence", "ord"}]
    first = F.min(F.struct("ord", *names)).alias("o")
    return occurrences.groupBy("kind", "key", "sentence").agg(first).select("kind", "key", "sentence", "o.*")


def tally(occurrences: DataFrame, everyday: list[str]) -> DataFrame:
    """``(kind, key, n, everyday, discontinuous, reflexive, initial, first)`` over ``occurrences(kind, key, sentence, ord, source, gap, reflexive, initial)``."""
    held = first_in_sentence(occurrences)
    return held.groupBy("kind", "key").agg(
        F.count("*").alias("n"), F.count_if(F.col("source").isin(everyday)).alias("everyday"), F.count_if(F.col("gap")).alias("discontinuous"),
        F.count_if(F.col("reflexive")).alias("reflexive"), F.count_if(F.col("initial")).alias("initial"), F.min("ord").alias("first"),
    )


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tallies of different sentences as one."""
    sums = ["n", "everyday", "discontinuous", "reflexive", "initial"]
    return a.unionByName(b).groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in sums], F.min("first").alias("first"))


def _rule(kind: str, t: Thresholds) -> Column:
    """The first reason against a mined unit of a kind, else null."""
    n, a, b, total = F.col("n"), F.col("n_a"), F.col("n_b"), F.col("total")
    lift, g2 = S.lift(n, a, b, total), S.log_likelihood(n, a, b, total)
    share = n / F.when(a > 0, a)
    few = lambda least: F.when(n < least, "count")
    if kind == "verb_prep":
        return F.when((n > 0) & (F.col("reflexive") / n >= t.reflexive_with_preposition), "mostly_reflexive").when(n < t.count, "count").when(F.coalesce(share, F.lit(0.0)) < t.governed_ratio, "ratio").when(lift < t.governed_lift, "lift")
    if kind == "reflexive_verb":
        return few(t.count).when(F.coalesce(share, F.lit(0.0)) < t.reflexive_share, "share")
    if kind == "separable_verb":
        return F.when(F.col("discontinuous") == 0, "fused_only").when(n < t.count, "count")
    if kind in {"noun_verb", "adj_noun"}:
        least, least_lift = (t.count, t.pair_lift) if kind == "noun_verb" else (t.adjective_count, t.adjective_lift)
        return few(least).when(F.least(a, b) < t.pair_lemma, "lemma_count").when(~F.col("listed"), "not_a_noun").when(F.col("everyday") < t.pair_everyday, "everyday").when(g2 < t.pair_g2, "g2").when(lift < least_lift, "lift")
    if kind == "adj_verb":
        return few(t.adverb_count).when(a < t.adverb_use, "adjective_use").when(F.col("everyday") < t.pair_everyday, "everyday").when(g2 < t.pair_g2, "g2").when(lift < t.adverb_lift, "lift")
    if kind == "expression":
        return few(t.carriers)
    return few(t.word_count)


def decided(stats: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``stats(kind, key, n, everyday, discontinuous, reflexive, n_a, n_b, total, listed, seeded, requested, excluded)`` with accept, reason, origin.

    An exclusion beats a request, a request beats a seed, a seed beats the rule of the kind. A curated
    kind (connector, idiom) needs its seed. ``origin``: mined, curated (never found) or mined+curated.
    """
    rule = F.lit(None).cast("string")
    for kind in ("verb_prep", "reflexive_verb", "separable_verb", "noun_verb", "adj_noun", "adj_verb", "expression"):
        rule = F.when(F.col("kind") == kind, _rule(kind, t)).otherwise(rule)
    other = ~F.col("kind").isin("verb_prep", "reflexive_verb", "separable_verb", "noun_verb", "adj_noun", "adj_verb", "expression", "connector", "idiom")
    rule = F.when(other, _rule("word", t)).when(F.col("kind").isin("connector", "idiom"), F.lit("not_listed")).otherwise(rule)
    reason = F.when(F.col("excluded"), "excluded").when(F.col("requested") | F.col("seeded"), F.lit(None).cast("string")).otherwise(rule)
    origin = F.when(F.col("seeded") & (F.col("n") == 0), "curated").when(F.col("seeded"), "mined+curated").otherwise("mined")
    return stats.withColumns({"reason": reason, "accept": reason.isNull(), "origin": origin})


def with_unseen(stats: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated units that no sentence has, as rows with counts of 0."""
    gone = curated.join(stats, ["kind", "key"], "left_anti")
    zero = {c: F.lit(0).cast("long") for c in ("n", "everyday", "discontinuous", "reflexive", "initial")}
    return stats.unionByName(gone.select("kind", "key").withColumns(zero).withColumn("first", F.lit(None).cast("long")))


def forced_words(accepted: DataFrame) -> DataFrame:
    """``(word)``: the parts of accepted collocations, which are units whatever their counts."""
    pairs = accepted.where(F.col("kind").isin("noun_verb", "adj_verb"))
    return pairs.select(F.explode(F.split("key", " ")).alias("word")).distinct()


def trivial(units: DataFrame, stoplist: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``units`` with ``trivial_reason``: on the stoplist, or a single word of a low rank; requested units never are."""
    held = units.join(stoplist.select(F.col("word").alias("key"), F.lit(True).alias("_stop")).distinct(), "key", "left")
    early = F.col("kind").isin("noun", "verb", "adjective", "adverb") & (F.col("rank") <= t.trivial_rank)
    reason = F.when(~F.col("requested"), F.when(F.coalesce("_stop", F.lit(False)), "stoplist").when(early, "rank"))
    return held.withColumn("trivial_reason", reason).drop("_stop")


def report(decisions: DataFrame) -> DataFrame:
    """``(kind, reason, n)``: how many units of a kind a reason rejects; null is accepted."""
    return decisions.groupBy("kind", "reason").agg(F.count("*").alias("n"))
