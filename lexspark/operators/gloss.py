"""Glosses and proposals: their normal form, why they are refused, and the order in which sentences are translated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X

MOST_CHARS, MOST_GLOSSES, CONTEXT_WORDS = 60, 3, (4, 14)


# Words in front of a verb's equivalent that stand for a negated one, and for "to have to".
NEGATED_LEADS = ("not to",)
FORCED_LEADS = ("must", "has to", "have to", "had to", "needs to", "need to")


def verb_gloss(gloss: Column) -> Column:
    """An equivalent of a verb with its ``to``; ``must`` has no infinitive and becomes ``to have to``."""
    text = F.trim(gloss)
    after = lambda leads: F.regexp_extract(text, rf"(?i)^(?:{'|'.join(leads)})\s+(.+)$", 1)
    negated, forced = after(NEGATED_LEADS), after(FORCED_LEADS)
    return (
        F.when(F.lower(text).startswith("to "), text).when(negated != "", F.concat(F.lit("to not "), negated))
        .when(forced != "", F.concat(F.lit("to have to "), forced)).otherwise(F.concat(F.lit("to "), text))
    )


def verb_glosses(glosses: Column) -> Column:
    """Equivalents in normal form, those that become equal but for their case once, the first one."""
    normal = F.transform(glosses, verb_gloss)
    first = lambda g, i: ~F.exists(F.slice(normal, F.lit(1), i), lambda h: F.lower(h) == F.lower(g))
    return F.filter(normal, first)


def german_leak(gloss: Column, display: Column, german_only: list[str]) -> Column:
    """Whether a gloss quotes words that are German only, or the phrase itself if it has several words."""
    folded = X.ascii_fold(F.lower(gloss))
    quoted = F.arrays_overlap(F.regexp_extract_all(folded, F.lit("[a-z]+"), F.lit(0)), F.array(*[F.lit(w) for w in german_only]))
    shown = X.ascii_fold(F.lower(display))
    return quoted | (shown.contains(" ") & folded.contains(shown))


def gloss_reason(glosses: Column, display: Column, german_only: list[str]) -> Column:
    """The first reason against a proposal's equivalents, in their order, else null."""
    reason = lambda g: (
        F.when(F.length(g) > MOST_CHARS, "too_long").when(F.lower(g) == F.lower(display), "german_echoed")
        .when(g.rlike(r"[\n{}\[\]]"), "malformed").when(german_leak(g, display, german_only), "german_leak")
    )
    found = F.array_compact(F.transform(F.slice(glosses, 1, MOST_GLOSSES), reason))
    return F.when(F.coalesce(F.size(glosses), F.lit(0)) <= 0, "empty").otherwise(F.get(found, F.lit(0)))


def context_reason(german: Column, english: Column, connector: Column, valid: Column) -> Column:
    """The first reason against a sentence of context before one that opens with a connector, else null."""
    de = F.trim(german)
    words = F.split(de, r"\s+")
    bare = F.transform(words, lambda w: F.trim(F.lower(w), F.lit(".,!?")))
    return (
        F.when(~F.size(words).between(*CONTEXT_WORDS), "length").when(~de.rlike("[.!?]$"), "no_terminal_punctuation").when(de.rlike('["„“\n]'), "quotes_or_newline")
        .when(F.array_contains(bare, F.get(F.split(F.lower(connector), " "), F.lit(0))), "contains_connector")
        .when(F.coalesce(F.trim(english), F.lit("")) == "", "empty_english").when(~valid, "carrier_rejected")
    )


def written_reason(german: Column, english: Column, surface: Column, lemma: Column, valid: Column) -> Column:
    """The first reason against a sentence that was written for a word, else null."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(blank(german) | blank(english) | blank(surface), "incomplete").when(~F.contains(german, surface), "surface_not_in_sentence")
        .when(F.contains(F.lower(english), F.lower(lemma)), "english_quotes_the_german").when(~X.gloss_ok(german, english), "gloss_implausible").when(~valid, "carrier_rejected")
    )


def passes(carriers: DataFrame, store: DataFrame, exercises: DataFrame, distrusted: list[str], valid: Column, seed: int = 1) -> DataFrame:
    """``carriers(text, ...)`` with ``queue`` and the key that orders it.

    exercise: a sentence in use without a trusted gloss; unglossed; replacement: the gloss is of a
    distrusted source; trusted: nothing to do; invalid: cannot host anything (never said of one in use).
    """
    held = carriers.join(store.select("text", F.col("source").alias("_by")), "text", "left").join(exercises.select("text", F.lit(True).alias("_used")), "text", "left")
    used = F.coalesce("_used", F.lit(False))
    by = F.col("_by")
    queue = (
        F.when(~used & ~valid, "invalid").when(by.isNotNull() & ~by.isin(distrusted), "trusted").when(used, "exercise").when(by.isNull(), "unglossed").otherwise("replacement")
    )
    return held.withColumn("queue", queue).withColumn("order_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("text")), 256)).drop("_by", "_used")


def needing_gloss(units: DataFrame) -> DataFrame:
    """Units without a gloss that are shown, in the order of their ranks."""
    return units.where("gloss is null and not trivial").orderBy("rank", "unit_id")


def with_glosses(units: DataFrame, records: DataFrame) -> DataFrame:
    """Units with accepted glosses joined in; a curated gloss stays."""
    told = records.where("accepted").select("unit_id", F.array_join("glosses", " / ").alias("_gloss"))
    return units.join(told, "unit_id", "left").withColumn("gloss", F.coalesce("gloss", "_gloss")).drop("_gloss")
