"""Example sentences of units: glosses, scores and the greedy pick with diverse forms, over sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X

# What a sentence's score takes for each flaw (survey C3).
CAPITAL_WORD, DIGIT_WORD, NEEDS_CONTEXT, REPEATED_FORM, UNGLOSSED, SOURCE_UNKNOWN = 15.0, 10.0, 20.0, 25.0, 30.0, 30.0


def sentence_score(text: Column, needs_context: Column, glossed: Column, penalty: Column) -> Column:
    """Lower is better: short plain sentences, glossed, of a good source; a repeated form is counted elsewhere."""
    words = F.split(F.trim(text), r"\s+")
    capitals = F.size(F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike(r"^\p{Lu}\p{L}{3,}$")))
    digits = F.size(F.filter(words, lambda w: w.rlike(r"\p{Nd}")))
    score = F.length(text) + CAPITAL_WORD * capitals + DIGIT_WORD * digits
    return score + F.when(needs_context, NEEDS_CONTEXT).otherwise(0.0) + F.when(glossed, 0.0).otherwise(UNGLOSSED) + F.coalesce(penalty, F.lit(SOURCE_UNKNOWN))


def hosting_once(occurrences: DataFrame) -> DataFrame:
    """Occurrences of a unit in a sentence that has it once only."""
    n = F.count("*").over(Window.partitionBy("unit_id", "text"))
    return occurrences.withColumn("_n", n).where("_n = 1").drop("_n")


def answer_leaks(text: Column, answers: Column) -> Column:
    """Whether an answer of more than two letters is in the sentence more often than in the gaps."""
    words = X.letter_tokens(text)
    low = F.transform(answers, lambda a: F.lower(a))
    return F.exists(low, lambda g: (F.length(g) > 2) & (F.size(F.filter(words, lambda w: w == g)) > F.size(F.filter(low, lambda x: x == g))))


def _phase(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows of a phase in the order in which a greedy pick takes them: ``(key, k0, bt, ord)``.

    The pick re-sorts after each take, since a form taken makes its other rows worse by
    ``REPEATED_FORM``. Only the best row of a form not taken before goes at its own score; all
    others of the form pay, and among equals keep the place that the re-sorting gave them.
    """
    held = rows.join(taken.withColumn("_taken", F.lit(True)), ["unit_id", "form_key"], "left")
    was = F.coalesce("_taken", F.lit(False))
    k0 = F.col("score") + F.when(was, REPEATED_FORM).otherwise(0.0)
    best = F.row_number().over(Window.partitionBy("unit_id", "form_key").orderBy("score", "ord"))
    held = held.withColumn("k0", k0).withColumn("_best", ~was & (best == 1))
    held = held.withColumn("key", F.when(F.col("_best"), F.col("score")).otherwise(F.col("score") + REPEATED_FORM))
    place = F.sum(F.col("_best").cast("int")).over(Window.partitionBy("unit_id").orderBy("key", "ord").rowsBetween(Window.unboundedPreceding, 0))
    lead = F.max(F.when(F.col("_best"), F.col("_place"))).over(Window.partitionBy("unit_id", "form_key"))
    held = held.withColumn("_place", place).withColumn("_lead", lead)
    return held.withColumn("bt", F.when(F.col("key") == F.col("k0"), F.lit(0)).otherwise(-F.col("_lead"))).drop("_taken", "_best", "_place", "_lead")


def picked(candidates: DataFrame, slots: Column) -> DataFrame:
    """The cards of each unit: up to ``slots`` valid ``candidates(unit_id, ord, form_key, score, kept)``.

    Deployed ones (``kept``) are picked first, then fresh ones for the slots left. Adds ``phase``
    and ``place`` (the order of picking).
    """
    none = candidates.select("unit_id", "form_key").limit(0)
    order = [F.col(c) for c in ("key", "k0", "bt", "ord")]
    take = lambda df, free: df.withColumn("place", F.row_number().over(Window.partitionBy("unit_id").orderBy(*order))).where(F.col("place") <= free)
    first = take(_phase(candidates.where("kept"), none), slots).withColumn("phase", F.lit(1))
    used = first.groupBy("unit_id").agg(F.count("*").alias("_used"))
    second = _phase(candidates.where("not kept"), first.select("unit_id", "form_key").distinct())
    second = second.join(used, "unit_id", "left").withColumn("_used", F.coalesce("_used", F.lit(0)))
    second = take(second, slots - F.col("_used")).withColumn("place", F.col("place") + F.col("_used")).drop("_used").withColumn("phase", F.lit(2))
    return first.unionByName(second)
