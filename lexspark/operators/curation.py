"""Hand-made lists over a deck: overrides, requests, added units, folded counts, reserves, bands of rarity, quota days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import ranking

# Ranks of a frequency list up to which a word without a level counts as of that band, and what others count as.
FALLBACK_BANDS = ((5_000, "A1"), (10_000, "A2"), (20_000, "B1"), (50_000, "B2"))
ABOVE_ALL_BANDS = "C"
QUOTA_ZONE = "America/Los_Angeles"


def fallback_band(rank: Column) -> Column:
    """The band of a frequency rank; words beyond the last, or in no list, are above all bands."""
    found = F.lit(ABOVE_ALL_BANDS)
    for last, name in FALLBACK_BANDS[::-1]:
        found = F.when(rank <= last, F.lit(name)).otherwise(found)
    return found


def next_quota_midnight(at: Column) -> Column:
    """The next midnight where the quota is counted, as UTC; ``at`` is UTC too."""
    return F.to_utc_timestamp(F.date_add(F.to_date(F.from_utc_timestamp(at, QUOTA_ZONE)), 1).cast("timestamp"), QUOTA_ZONE)


def quota_month(at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, QUOTA_ZONE), "yyyy-MM")


def merged_overrides(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Overrides by key, each field the new one's where it has one."""
    a, b = (df.select("key", *[F.col(f).alias(f"{f}_{side}") for f in fields]) for df, side in ((old, "a"), (new, "b")))
    return a.join(b, "key", "full").select("key", *[F.coalesce(f"{f}_b", f"{f}_a").alias(f) for f in fields])


def overridden(units: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """``units`` with the fields of ``overrides(key, only_kind, fields...)`` of their key, unless these are for another kind."""
    held = overrides.select(F.col("key").alias("_key"), "only_kind", *[F.col(f).alias(f"_{f}") for f in fields])
    own = (units["key"] == held["_key"]) & (held["only_kind"].isNull() | (held["only_kind"] == units["kind"]))
    return units.join(held, own, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else units[c] for c in units.columns])


def with_requests(units: DataFrame, requests: DataFrame) -> DataFrame:
    """``units`` with ``requested_order``: the place of the first entry of ``requests(pos, key, kind)`` that names them; entries for adverbs also name adjectives."""
    kind = F.explode(F.when(F.col("kind") == "adverb", F.array(F.lit("adverb"), F.lit("adjective"))).otherwise(F.array("kind")))
    first = requests.select("pos", "key", kind.alias("kind")).groupBy("key", "kind").agg(F.min("pos").alias("requested_order"))
    return units.join(first, ["key", "kind"], "left")


def with_added(deck: DataFrame, added: DataFrame) -> DataFrame:
    """The deck and the units that learners added, where both have one the deck's."""
    return deck.unionByName(added.join(deck.select("unit").distinct(), "unit", "left_anti"))


def later_file_wins(files: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, that of the last file that has it; of several rows in a file the least."""
    dealt = files[0].withColumn("_file", F.lit(0))
    for i, df in enumerate(files[1:], 1):
        dealt = dealt.unionByName(df.withColumn("_file", F.lit(-i)))
    names = [c for c in files[0].columns if c != key]
    return dealt.groupBy(key).agg(F.min(F.struct("_file", *names)).alias("_r")).select(key, *[f"_r.{c}" for c in names])


def wanted_lines(carriers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Carriers and those of the wanted lines whose text no carrier has; what is there keeps its identity."""
    return carriers.unionByName(wanted.join(carriers.select("text").distinct(), "text", "left_anti").dropDuplicates(["text"]))


def contradictory(rows: DataFrame, told: DataFrame, confirmed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are told of, but not confirmed."""
    return rows.join(told.select(*keys).distinct(), keys, "left_semi").join(confirmed.select(*keys).distinct(), keys, "left_anti")


def folded_counts(counts: DataFrame, forms: DataFrame) -> DataFrame:
    """``(key, n)``: counts of a key and of the forms that ``forms(form, key)`` fold into it."""
    held = counts.join(forms.select(F.col("form").alias("key"), F.col("key").alias("_base")), "key", "left")
    return held.groupBy(F.coalesce("_base", "key").alias("key")).agg(F.sum("n").alias("n"))


def governed(pairs: DataFrame) -> DataFrame:
    """``(verb, preps)``: the prepositions that a verb governs, in order."""
    return pairs.groupBy("verb").agg(F.sort_array(F.collect_set("prep")).alias("preps"))


def reserve_ranks(reserve: DataFrame, deck: DataFrame) -> DataFrame:
    """``reserve(unit, n)`` ranked by count, then id, after the deck's last rank."""
    last = deck.agg(F.max("rank")).first()[0] or 0
    return ranking.ranked(reserve, [-F.col("n"), F.col("unit")], start=last + 1)


def first_requests(log: DataFrame) -> DataFrame:
    """``(learner, unit, place)``: a learner's requests in the order in which each unit was asked for first."""
    first = log.groupBy("learner", "unit").agg(F.min(F.struct("ts", "seq")).alias("_at"))
    return first.select("learner", "unit", F.row_number().over(Window.partitionBy("learner").orderBy("_at")).alias("place"))


def showable_cards(cards: DataFrame) -> DataFrame:
    """Cards with a gloss; of a unit that has such with all the context they need, only these."""
    fit = ~F.col("needs_context") | F.col("context").isNotNull()
    some = F.max(fit).over(Window.partitionBy("unit"))
    return cards.where("gloss is not null").withColumn("_some", some).where(fit | ~F.col("_some")).drop("_some")


def unread_batches(cards: DataFrame, read: DataFrame, size: int) -> DataFrame:
    """Cards that nobody has read yet, in rank order, in batches of ``size`` from 1."""
    return ranking.ranked(cards.join(read.select("card").distinct(), "card", "left_anti"), [F.col("rank"), F.col("card")], "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size) + 1).drop("_place")


def findings_of_batch(findings: DataFrame, batch: DataFrame, categories: list[str]) -> DataFrame:
    """Findings of known categories about cards of the batch."""
    return findings.where(F.col("category").isin(categories)).join(batch.select("card").distinct(), "card", "left_semi")
