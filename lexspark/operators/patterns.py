"""Curated word patterns in sentences: idioms, connectors, and what lies inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.storage import stored


def _reach(words: Column, pattern: Column, gap: Column, start: Column) -> Column:
    """The places of a pattern's words from ``start`` on, each the first one within the gap after the last; empty if one is missing."""

    def step(at: Column, w: Column) -> Column:
        last = F.element_at(at, -1)
        near = F.filter(F.sequence(last + 1, last + 1 + gap), lambda i: F.get(words, i) == w)
        found = F.get(near, F.lit(0))
        return F.when(F.size(at) == 0, at).when(found.isNull(), F.slice(at, 1, 0)).otherwise(F.concat(at, F.array(found)))

    rest = F.slice(pattern, F.lit(2), F.greatest(F.size(pattern) - 1, F.lit(0)))
    return F.aggregate(rest, F.array(start), step)


def pattern_hits(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(key, line_id, places)``: the first hit of each pattern in each sentence.

    ``patterns(key, words, max_gap, unless)`` is a curated list; words between two of a pattern are
    ``max_gap`` at most, and a sentence with a word of ``unless`` has no hit. Sentences meet patterns
    by the first word, in an equi-join; patterns without words hit nothing.
    """
    held = lines.select("line_id", X.letter_tokens(F.col("text")).alias("words"))
    each = held.select("line_id", "words", F.posexplode("words").alias("start", "first"))
    curated = patterns.where(F.size("words") > 0).select("key", F.col("words").alias("pattern"), "max_gap", F.coalesce("unless", F.array().cast("array<string>")).alias("unless"), F.get("words", F.lit(0)).alias("first"))
    hit = each.join(curated, "first").where(~F.arrays_overlap("words", "unless"))
    hit = hit.withColumn("places", _reach(F.col("words"), F.col("pattern"), F.col("max_gap"), F.col("start"))).where(F.size("places") == F.size("pattern"))
    return hit.groupBy("key", "line_id").agg(F.min("places").alias("places"))


def longest_hits(hits: DataFrame) -> DataFrame:
    """Hits that do not lie inside a longer one of the same sentence. They are stored, being looked at three times."""
    hits = stored(hits)
    a = hits.select("line_id", F.col("key").alias("outer"), F.col("places").alias("around"))
    inside = hits.join(a, "line_id").where((F.size("around") > F.size("places")) & (F.size(F.array_except("places", "around")) == 0))
    return hits.join(inside.select("key", "line_id").distinct(), ["key", "line_id"], "left_anti")


def inside_hits(gaps: DataFrame, hits: DataFrame) -> DataFrame:
    """``gaps(card, line_id, place)`` that are words of a hit in their sentence."""
    places = hits.select("line_id", F.explode("places").alias("place")).distinct()
    return gaps.join(places, ["line_id", "place"], "left_semi")


def split_spelling(words: Column, display: Column) -> Column:
    """Whether a unit of one word is written as several."""
    return ~display.contains(" ") & (F.size(words) > 1) & (F.array_join(F.transform(words, lambda w: F.lower(w)), "") == F.lower(display))
