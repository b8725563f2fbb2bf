"""Levels of words through their lemmas, and ceilings of level for sentences.

What is known about a word does not hang on its sentence but for separated prefixes, so everything is worked out once for
each distinct word, in tables that are joined: candidates for its lemma in order, levels of those that the
vocabulary has, compounds for words without any. Sentences then meet one row for each of their words.

Words are in normal form (``text.normalise``). ``vocabulary(word, level)`` has ranks of levels from 1; ``irregular(form, lemma)``,
``function_words(word)`` and ``names(word)`` are lists that the caller has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import compound_splits, normalise
from lexspark.operators.trees import PREFIXES
from lexspark.storage import stored

#: Rows of a table of words that is broadcast; beyond that it is joined by a shuffle, which AQE splits.
BROADCAST_WORDS = 500_000

# Endings that are tried, elements between parts of a compound, words one level above a ceiling that a sentence may have, frequency ranks from 1 below which a word counts as of level 1, 2, 3 and 4
ENDINGS = ["test", "tet", "ten", "te", "est", "et", "em", "en", "er", "es", "st", "e", "t", "n", "s"]
LINKS = ["es", "en", "ns", "e", "n", "s"]
LEAST_STEM, LEAST_PART = 3, 4
ONE_ABOVE = 2
RANK_LEVELS = ((5_000, 1), (10_000, 2), (20_000, 3), (50_000, 4))
RAREST = 5
TOKEN, CONTENT = r"[\p{L}\p{N}_]+", "^[A-ZÄÖÜa-zäöüß]{3,}$"
LETTERS = "^[A-ZÄÖÜa-zäöüß]+$"


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_WORDS else df


def _cut(x: Column, n: int) -> Column:
    return F.substr(x, F.lit(1), F.greatest(F.length(x) - n, F.lit(0)))


def _stripped(x: Column) -> list[Column]:
    """A word without each ending that leaves a stem, nulls for those that do not fit."""
    return [F.when(x.endswith(e) & (F.length(x) - len(e) >= LEAST_STEM), _cut(x, len(e))) for e in ENDINGS]


def _active(x: Column) -> Column:
    """An active participle without its last letter: "spielend" as "spielen"."""
    return F.when(x.endswith("d") & (F.length(x) - 1 >= LEAST_STEM), _cut(x, 1))


def _some(*found: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def ordered_stems(word: Column) -> Column:
    """The word itself, then all stems that endings, ``ge-`` and participles leave, longest first, equally long ones by the alphabet."""
    core = F.substr(word, F.lit(3))
    is_participle = word.startswith("ge") & (F.length(word) > 2 + LEAST_STEM)
    weak = F.when(core.endswith("et") & (F.length(core) - 2 >= LEAST_STEM), _cut(core, 2)).when(~core.endswith("et") & core.endswith("t") & (F.length(core) - 1 >= LEAST_STEM), _cut(core, 1))
    weak = weak.when(core.endswith("et") & (F.length(core) - 2 < LEAST_STEM) & (F.length(core) - 1 >= LEAST_STEM), _cut(core, 1))
    roots = _some(word, F.when(is_participle, core), F.when(is_participle, weak))
    stems = F.flatten(F.transform(roots, lambda r: F.concat(F.array(r), _some(*_stripped(r), _active(r)))))
    stems = F.array_distinct(F.flatten(F.transform(stems, lambda s: _some(s, _active(s)))))
    placed = F.array_sort(F.transform(stems, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("stem"))))
    return F.array_distinct(F.concat(F.array(word), F.transform(placed, lambda p: p["stem"])))


def lemma_candidates(words: DataFrame, irregular: DataFrame) -> DataFrame:
    """``(word, place, candidate)``: what the lemma of each distinct word may be, in the order in which it is tried.

    Each stem is tried as it is, as an infinitive and as an irregular form, then the same without umlauts. Words of one letter are their own only candidate.
    """
    short = F.length("word") < 2
    stems = words.select("word").distinct().select("word", F.posexplode(F.when(short, F.array("word")).otherwise(ordered_stems(F.col("word")))).alias("at", "stem"))
    stem, plain = F.col("stem"), F.translate("stem", "äöü", "aou")
    infinitive = lambda x: F.when(~x.endswith("en") & (F.length(x) >= LEAST_STEM), F.concat(x, F.lit("en")))
    other = plain != stem
    tried = [(stem, False), (infinitive(stem), False), (stem, True), (F.when(other, plain), False), (F.when(other, infinitive(plain)), False), (F.when(other, plain), True)]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.when(short & F.lit(i > 0), None).otherwise(x).alias("x"), F.lit(via).alias("via")) for i, (x, via) in enumerate(tried)])
    rows = stems.select("word", "at", F.inline(F.filter(slots, lambda s: s["x"].isNotNull())))
    found = rows.join(_broadcast(irregular.select(F.col("form").alias("x"), "lemma").dropDuplicates(["x"]).withColumn("via", F.lit(True))), ["x", "via"], "left")
    found = found.withColumn("candidate", F.when(F.col("via"), F.col("lemma")).otherwise(F.col("x"))).where("candidate is not null and candidate <> ''")
    return found.groupBy("word", "candidate").agg(F.min(F.col("at") * len(tried) + F.col("slot")).alias("place"))


def compound_levels(words: DataFrame, direct: DataFrame) -> DataFrame:
    """``(word, compound)``: the level of words made of two that ``direct(word, level)`` has, with or without a link between them.

    A split is as hard as its harder part; the easiest split counts. Words that cannot be split do not appear.
    """
    split = words.select("word").distinct().select("word", F.inline(compound_splits(F.col("word"), LEAST_PART)))
    bare = F.array(F.col("head"), *[F.when(F.col("head").endswith(x) & (F.length("head") - len(x) >= LEAST_PART), _cut(F.col("head"), len(x))) for x in LINKS])
    split = split.select("word", "tail", F.explode(F.array_distinct(F.filter(bare, lambda x: x.isNotNull()))).alias("head"))
    known = _broadcast(stored(direct))
    tails = split.join(known.select(F.col("word").alias("tail"), F.col("level").alias("of_tail")), "tail")
    both = tails.join(known.select(F.col("word").alias("head"), F.col("level").alias("of_head")), "head")
    return both.groupBy("word").agg(F.min(F.greatest("of_head", "of_tail")).alias("compound"))


def word_facts(words: DataFrame, vocabulary: DataFrame, irregular: DataFrame, function_words: DataFrame, names: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row for each distinct word.

    ``first``: level of the first candidate that the vocabulary has; ``easiest``: the lowest level of all of them; ``with_prefix``: the same for
    separated prefixes, by prefix; ``compound``; ``fallback``: a level by the rank (from 1) in ``ranks(word, rank)``; ``is_function``, ``is_name``.
    """
    words = stored(words.select("word").where("word is not null").distinct())
    candidates = stored(lemma_candidates(words, irregular))
    levels = stored(vocabulary.groupBy("word").agg(F.min("level").alias("level")))
    known = _broadcast(levels.select(F.col("word").alias("candidate"), "level"))
    hits = candidates.join(known, "candidate").groupBy("word").agg(F.min_by("level", "place").alias("first"), F.min("level").alias("easiest"))
    cuts = F.array(*[F.when(F.col("word").startswith(p), F.struct(F.lit(p).alias("prefix"), F.substr("word", F.lit(len(p) + 1)).alias("candidate"))) for p in PREFIXES])
    prefixed = levels.select("level", F.inline(F.filter(cuts, lambda c: c.isNotNull() & c["candidate"].endswith("en") & (F.length(c["candidate"]) >= 4))))  # verbs of the vocabulary, without a prefix
    apart = candidates.join(_broadcast(stored(prefixed)), "candidate").groupBy("word", "prefix").agg(F.min("level").alias("level"))
    apart = apart.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "level"))).alias("with_prefix"))  # one for each prefix, at most
    function, name = (df.select("word").distinct().withColumn(c, F.lit(True)) for df, c in ((function_words, "is_function"), (names, "is_name")))
    direct = levels.join(function, "word", "left_anti").select("word", "level").union(function.select("word", F.lit(1).cast(levels.schema["level"].dataType)))
    compounds = compound_levels(words.join(hits, "word", "left_anti"), direct)
    chain = F.when(F.lit(False), F.lit(RAREST))
    for upper, level in RANK_LEVELS:
        chain = chain.when(F.col("rank") < upper, F.lit(level))
    held = words
    for df in (hits, apart, compounds, ranks.groupBy("word").agg(F.min("rank").alias("rank")), function, name):
        held = held.join(df, "word", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return held.select("word", "first", "easiest", "with_prefix", "compound", chain.otherwise(RAREST).alias("fallback"), flag("is_function"), flag("is_name"))


def word_level(facts: DataFrame) -> DataFrame:
    """``(word, level)``: 1 for function words, else the first candidate's level, else the compound's, else null."""
    return facts.select("word", F.when(F.col("is_function"), F.lit(1)).otherwise(F.coalesce("first", "compound")).alias("level"))


def sentence_words(lines: DataFrame) -> DataFrame:
    """``(line_id, at, token, word, prefixes)`` of ``lines(line_id, text)``: tokens of three or more letters, and the separable prefixes that the sentence has as tokens."""
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    held = lines.select("line_id", tokens.alias("tokens"))
    shown = F.array_intersect(F.transform(F.filter("tokens", lambda t: t.rlike(LETTERS)), lambda t: normalise(t)), F.array(*[F.lit(p) for p in PREFIXES]))
    return held.select("line_id", shown.alias("prefixes"), F.posexplode("tokens").alias("at", "token")).where(F.col("token").rlike(CONTENT)).withColumn("word", normalise(F.col("token")))


def _easiest(words: DataFrame, facts: DataFrame) -> DataFrame:
    """Sentence words with their facts and ``own``, the easiest level of any reading here, null for none."""
    held = words.join(_broadcast(facts), "word", "left")
    apart = F.when(F.col("with_prefix").isNotNull() & (F.size("prefixes") > 0), F.array_min(F.filter(F.transform("prefixes", lambda p: F.col("with_prefix")[p]), lambda x: x.isNotNull())))  # few words make verbs with prefixes
    return held.withColumn("own", F.coalesce(F.least("easiest", apart), F.col("compound")))


def ceiling_check(lines: DataFrame, facts: DataFrame, ceiling: int, one_above: int = ONE_ABOVE) -> DataFrame:
    """``(line_id, violations, over_budget, unknown)`` of every line, arrays of tokens in their order.

    A word two or more levels above ``ceiling`` is a violation; words one level above are the sentence's ``over_budget``, and
    violations (after the others) if there are more than ``one_above``. A word without a reading counts by its frequency and is
    ``unknown``. Function words and names are neither; lines without words have empty arrays. Facts of all words are one table, so only
    the words that break the ceiling are gathered by line.
    """
    told = _easiest(sentence_words(lines), facts).where(~F.coalesce("is_function", F.lit(False)) & ~F.coalesce("is_name", F.lit(False)))
    above = F.coalesce("own", "fallback", F.lit(RAREST)) - F.lit(ceiling)
    told = told.select("line_id", F.struct("at", "token").alias("t"), above.alias("above"), F.col("own").isNull().alias("unknown")).where((F.col("above") > 0) | F.col("unknown"))
    of = lambda cond: F.collect_list(F.when(cond, F.col("t")))
    gathered = told.groupBy("line_id").agg(of(F.col("above") >= 2).alias("hard"), of(F.col("above") == 1).alias("over"), of(F.col("unknown")).alias("none"))
    tokens = lambda c: F.coalesce(F.transform(F.array_sort(c), lambda x: x["token"]), F.array().cast("array<string>"))
    held = lines.select("line_id").join(gathered, "line_id", "left")
    hard, over = tokens("hard"), tokens("over")
    return held.select("line_id", F.when(F.size(over) > one_above, F.concat(hard, over)).otherwise(hard).alias("violations"), over.alias("over_budget"), tokens("none").alias("unknown"))


def within_ceiling(words: DataFrame, facts: DataFrame, ceiling: int) -> DataFrame:
    """Sentence words with ``within``: whether any reading is at or below ``ceiling``; words without a reading pass."""
    held = _easiest(words, facts)
    skipped = F.coalesce("is_function", F.lit(False)) | F.coalesce("is_name", F.lit(False))
    return held.select(*words.columns, (skipped | F.col("own").isNull() | (F.col("own") <= ceiling)).alias("within"))
