"""Levels of words and sentences by frequency, and what learners hold by how firmly and when it is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X

# Ranks below which a word belongs to A1, A2, B1 and B2, letters of a long word, days of stability below which a unit is in a band.
BAND_RANKS = (("A1", 5_000), ("A2", 10_000), ("B1", 20_000), ("B2", 50_000))
LONG_WORD = 12
STABILITY_BANDS = (("fresh", 7.0), ("young", 21.0), ("mature", 90.0))
FIRMEST = "solid"


def _first_below(x: Column, bounds: tuple[tuple[str, float], ...], otherwise: str) -> Column:
    chain = F.when(F.lit(False), otherwise)
    for name, upper in bounds:
        chain = chain.when(x < upper, name)
    return chain.otherwise(otherwise)


def frequency_band(rank: Column) -> Column:
    """The level of a word by its rank from 0 in a frequency list; rarer or unlisted (null) words are ``above``."""
    return _first_below(rank, BAND_RANKS, "above")


def stability_band(stability: Column) -> Column:
    """How firmly a unit is held; null if it was never reviewed."""
    return F.when(stability.isNotNull(), _first_below(stability, STABILITY_BANDS, FIRMEST))


def difficulty_tiers(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """``(line_id, tier)`` of ``lines(line_id, text)``: 3 with two long words or three that are not in ``frequent(word)``, 2 with one of either, else 1.

    Words count each time. Lines without words are of tier 1; with no frequent words at all none counts as rare.
    """
    known = frequent.select(X.normalise(F.col("word")).alias("word"), F.lit(True).alias("held")).distinct()
    listed = not frequent.isEmpty()
    words = lines.select("line_id", F.explode_outer(X.letter_tokens(F.col("text"))).alias("raw")).withColumn("word", X.normalise(F.col("raw")))
    met = words.join(known, "word", "left")
    rare = F.count_if(F.col("word").isNotNull() & F.col("held").isNull()) if listed else F.lit(0)
    counted = met.groupBy("line_id").agg(F.count_if(F.length("raw") >= LONG_WORD).alias("long"), rare.alias("rare"))
    tier = F.when((F.col("long") >= 2) | (F.col("rare") >= 3), 3).when((F.col("long") >= 1) | (F.col("rare") >= 1), 2).otherwise(1)
    return counted.select("line_id", tier.alias("tier"))


def due_counts(states: DataFrame, now: Column) -> DataFrame:
    """``(learner, now, today, tomorrow)``: units due by ``now``, by the end of its day (those included) and in the next day.

    Days are those of the session's time zone. Learners with nothing due until then have zeros.
    """
    end = F.date_trunc("day", now) + F.expr("interval 1 day")
    due = F.col("due").cast("timestamp")
    return states.groupBy("learner").agg(
        F.count_if(due <= now).alias("now"), F.count_if(due < end).alias("today"), F.count_if((due >= end) & (due < end + F.expr("interval 1 day"))).alias("tomorrow"),
    )


def contradictory(store: DataFrame, carriers: DataFrame, pairs: DataFrame, claimed: str) -> DataFrame:
    """Records of ``store(german, source)`` that claim to come from ``claimed`` although their text is one of ``carriers`` only.

    Texts that are in ``pairs`` too are spared. Both are looked up by equi-joins.
    """
    held = store.where(F.col("source") == claimed)
    return held.join(carriers.select("german").distinct(), "german", "left_semi").join(pairs.select("german").distinct(), "german", "left_anti")
