"""Paradigms of German as relations: forms with the cells that they fill, made from endings and rules and looked up by joins on the form.

A cell is case, gender and number, or person and number with a tense. Closed classes are a table of some hundred rows; adjectives
and weak verbs are declined and conjugated for a whole column of words at once. One form usually fills several cells; a phrase is told by the
cells that all its words share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.trees import INSEPARABLE, PREFIXES, told

# Forms and endings by case, for masculine, feminine, neuter and plural; - for no ending, . for a cell that the family has no form for
DEFINITE = {"Nom": "der die das die", "Acc": "den die das die", "Dat": "dem der dem den", "Gen": "des der des der"}
EIN = {"Nom": "- e - .", "Acc": "en e - .", "Dat": "em er em en", "Gen": "es er es er"}
ADJECTIVE = {
    "weak": {"Nom": "e e e en", "Acc": "en e e en", "Dat": "en en en en", "Gen": "en en en en"},
    "mixed": {"Nom": "er e es en", "Acc": "en e es en", "Dat": "en en en en", "Gen": "en en en en"},
    "strong": {"Nom": "er e es e", "Acc": "en e es e", "Dat": "em er em en", "Gen": "en er en er"},
}
RELATIVE = {"Nom": "der die das die", "Acc": "den die das die", "Dat": "dem der dem denen", "Gen": "dessen deren dessen deren"}
EIN_STEMS = ["kein", "mein", "dein", "sein", "ihr", "unser", "euer", "eur", "ein"]
# by case, for ich, du, er, sie (one), es, wir, ihr, sie (many)
PERSONAL = {"Nom": "ich du er sie es wir ihr sie", "Acc": "mich dich ihn sie es uns euch sie", "Dat": "mir dir ihm ihr ihm uns euch ihnen"}
REFLEXIVE = {"Acc": "mich dich sich sich sich uns euch sich", "Dat": "mir dir sich sich sich uns euch sich"}
PERSONS = [("1", "Sing", "Unk"), ("2", "Sing", "Unk"), ("3", "Sing", "Masc"), ("3", "Sing", "Fem"), ("3", "Sing", "Neut"), ("1", "Plur", "Unk"), ("2", "Plur", "Unk"), ("3", "Plur", "Unk")]
FINITE = [("1", "Sing"), ("2", "Sing"), ("3", "Sing"), ("1", "Plur"), ("2", "Plur"), ("3", "Plur")]
PRESENT, PAST = "e st t en t en".split(), "te test te ten tet ten".split()
GENDERS = ["Masc", "Fem", "Neut"]
PLURALS = ["e", "er", "s"]
ZU_PREFIXES = sorted([*PREFIXES, "wieder"], key=lambda p: (-len(p), p))
_LONGEST = sorted(PREFIXES, key=lambda p: (-len(p), p))


def cells(table: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """``(ending, case, gender, number)``; the plural is the same in all genders."""
    out = []
    for case, row in table.items():
        *singular, plural = row.split()
        out += [(e, case, g, "Sing") for e, g in zip(singular, GENDERS)] + [(plural, case, g, "Plur") for g in GENDERS]
    return [("" if e == "-" else e, *rest) for e, *rest in out if e != "."]


def closed_rows() -> list[tuple]:
    """``(family, lemma, form, case, gender, number, person)`` of articles, words like "ein", personal, reflexive and relative pronouns."""
    rows = [("definite", "der", e, c, g, n, None) for e, c, g, n in cells(DEFINITE)]
    rows += [("ein", s, s + e, c, g, n, None) for s in EIN_STEMS for e, c, g, n in cells(EIN)]
    rows += list(dict.fromkeys(("relative", "der", e, c, g if n == "Sing" else "Unk", n, None) for e, c, g, n in cells(RELATIVE)))
    for family, table in (("personal", PERSONAL), ("reflexive", REFLEXIVE)):
        told_ = [(family, family, f, c, g if family == "personal" else "Unk", n, p) for c, row in table.items() for f, (p, n, g) in zip(row.split(), PERSONS)]
        rows += list(dict.fromkeys(told_))
    return rows


def closed_forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(closed_rows(), "family string, lemma string, form string, case string, gender string, number string, person string")


def declined(stems: DataFrame) -> DataFrame:
    """``(lemma, form, declension, case, gender, number)`` of adjectives ``stems(lemma)`` in all three declensions. Stems of "-el" and "-er" keep their e."""
    rows = [F.struct(F.lit(d).alias("declension"), F.lit(e).alias("ending"), F.lit(c).alias("case"), F.lit(g).alias("gender"), F.lit(n).alias("number")) for d, t in ADJECTIVE.items() for e, c, g, n in cells(t)]
    held = stems.select("lemma").where("lemma is not null").distinct().select("lemma", F.inline(F.array(*rows)))
    return held.select("lemma", F.concat("lemma", "ending").alias("form"), "declension", "case", "gender", "number")


def adjective_forms(stems: DataFrame) -> DataFrame:
    """``(lemma, form, cells, strong, first_case)``: ``declined`` with one row for each form: how many cells it fills, how many of them are strong, the first case.

    What an ending fills is the same for all adjectives, so it is counted here and not after a row for each cell has been shuffled.
    """
    filled: dict[str, list[tuple[str, str]]] = {}
    for declension, table in ADJECTIVE.items():
        for ending, case, *_ in cells(table):
            filled.setdefault(ending, []).append((declension, case))
    long = lambda n: F.lit(n).cast("long")
    rows = [F.struct(F.lit(e).alias("ending"), long(len(x)).alias("cells"), long(sum(d == "strong" for d, _ in x)).alias("strong"), F.lit(min(c for _, c in x)).alias("first_case")) for e, x in filled.items()]
    held = stems.select("lemma").where("lemma is not null").distinct().select("lemma", F.inline(F.array(*rows)))
    return held.select("lemma", F.concat("lemma", "ending").alias("form"), "cells", "strong", "first_case")


def weak_stem(lemma: Column) -> Column:
    """An infinitive without its ending, null for what is none."""
    n = F.length(lemma)
    return F.when(lemma.endswith("en") & (n > 3), F.substr(lemma, F.lit(1), n - 2)).when(lemma.endswith("n") & (n > 2), F.substr(lemma, F.lit(1), n - 1))


def _ends(x: Column, endings: list[str]) -> Column:
    found = F.lit(False)
    for e in endings:
        found = found | x.endswith(e)
    return found


def present_form(lemma: Column, person: str, number: str) -> Column:
    """The present of a weak verb: no second s after a sibilant, an e after d and t."""
    stem, cell = weak_stem(lemma), (person, number)
    form = F.concat(stem, F.lit(PRESENT[FINITE.index(cell)]))
    if cell == ("2", "Sing"):
        return F.when(_ends(stem, ["s", "z", "x"]), F.concat(stem, F.lit("t"))).when(_ends(stem, ["d", "t"]), F.concat(stem, F.lit("est"))).otherwise(form)
    return F.when(_ends(stem, ["d", "t"]), F.concat(stem, F.lit("et"))).otherwise(form) if cell in {("2", "Plur"), ("3", "Sing")} else form


def past_form(lemma: Column, person: str, number: str) -> Column:
    stem, ending = weak_stem(lemma), PAST[FINITE.index((person, number))]
    return F.concat(stem, F.when(_ends(stem, ["d", "t"]), F.lit("e")).otherwise(F.lit("")), F.lit(ending))


def conjugated(lemmas: DataFrame) -> DataFrame:
    """``(lemma, form, tense, person, number)``: the twelve finite forms of each of ``lemmas(lemma)`` by the rules of weak verbs; words that are no infinitives have none."""
    x = F.col("lemma")
    rows = [F.struct(F.lit(t).alias("tense"), F.lit(p).alias("person"), F.lit(n).alias("number"), f(x, p, n).alias("form")) for t, f in (("Pres", present_form), ("Past", past_form)) for p, n in FINITE]
    return lemmas.select("lemma").distinct().where(weak_stem(x).isNotNull()).select("lemma", F.inline(F.array(*rows))).select("lemma", "form", "tense", "person", "number")


def weak_infinitives(surface: Column) -> Column:
    """Infinitives whose third person present the form can be, checked by the rule itself; nothing says that they are words."""
    x = F.lower(F.trim(surface))
    raw = F.array(F.concat(F.substr(x, F.lit(1), F.length(x) - 1), F.lit("en")), F.when(x.endswith("et") & (F.length(x) > 3), F.concat(F.substr(x, F.lit(1), F.length(x) - 2), F.lit("en"))))
    fits = F.filter(raw, lambda c: told(present_form(c, "3", "Sing") == x))
    return F.when(x.endswith("t") & (F.length(x) >= 3), F.array_sort(F.array_distinct(fits))).otherwise(F.array().cast("array<string>"))


def _rest(x: Column, prefixes: list[str]) -> Column:
    """What follows the longest of ``prefixes`` that a word begins with, null for none."""
    found = F.when(F.lit(False), x)
    for p in prefixes:
        found = found.when(x.startswith(p) & (F.length(x) > len(p)), F.substr(x, F.lit(len(p) + 1)))
    return found


def _participle_end(x: Column) -> Column:
    return x.endswith("t") | (x.endswith("en") & (F.length(x) > 2))


def _inseparable(x: Column) -> Column:
    found = F.lit(False)
    for p in INSEPARABLE:
        found = found | (x.startswith(p) & (F.length(x) > len(p)))
    return found


def participle_shape(text: Column) -> Column:
    """Whether a word is spelled like a past participle: ``ge`` in front or after a separable prefix, or an inseparable prefix and t; never with an infixed ``zu``."""
    x = F.lower(text)
    rest = _rest(x, _LONGEST)
    return F.when(told(rest.startswith("zu") & (F.length(rest) > 2)), False).otherwise(
        told(rest.startswith("ge") & _participle_end(rest)) | told(x.startswith("ge") & _participle_end(x)) | told(_inseparable(x) & x.endswith("t"))
    )


def zu_infinitive_shape(text: Column) -> Column:
    """Whether a word has ``zu`` between a separable prefix and its stem ("wiederzubeleben")."""
    x, found = F.lower(text), F.lit(False)
    for p in ZU_PREFIXES:
        found = found | (x.startswith(p + "zu") & (F.length(x) > len(p) + 2))
    return told(found)


def _unparticiple(x: Column) -> Column:
    n = F.length(x)
    dental = x.endswith("et") & (n > 2) & _ends(F.substr(x, F.lit(1), F.greatest(n - 2, F.lit(0))), ["d", "t"])
    return F.when(dental, F.concat(F.substr(x, F.lit(1), n - 2), F.lit("en"))).when(x.endswith("t") & (n > 1), F.concat(F.substr(x, F.lit(1), n - 1), F.lit("en")))


def with_participle_infinitives(words: DataFrame, known: DataFrame, name: str = "word") -> DataFrame:
    """``words`` with ``infinitive`` of a participle by its spelling; ``known(participle, infinitive)`` has those that no rule gives.

    The whole word is looked up first, then what follows a separable prefix, then endings of weak verbs are undone. Null where nothing fits.
    """
    x = F.lower(F.col(name))
    rest = _rest(x, _LONGEST)
    prefix = F.substr(x, F.lit(1), F.length(x) - F.length(rest))
    fits = told(rest.startswith("ge") & _participle_end(rest))
    table = known.groupBy("participle").agg(F.min("infinitive").alias("infinitive"))
    held = words.withColumn("_whole", x).withColumn("_rest", F.when(fits, rest))
    held = held.join(table.select(F.col("participle").alias("_whole"), F.col("infinitive").alias("_of_whole")), "_whole", "left").join(table.select(F.col("participle").alias("_rest"), F.col("infinitive").alias("_of_rest")), "_rest", "left")
    own = F.when(fits, F.concat(prefix, F.coalesce("_of_rest", _unparticiple(F.substr(rest, F.lit(3))))))
    own = own.when(x.startswith("ge") & _participle_end(x), _unparticiple(F.substr(x, F.lit(3)))).when(_inseparable(x) & x.endswith("t"), _unparticiple(x))
    return held.select(*words.columns, F.coalesce("_of_whole", own).alias("infinitive"))


def noun_plurals(lemma: Column) -> Column:
    """What a noun's plural may be, sorted: the usual endings, with and without an umlaut of the last vowel; no n after a double consonant."""
    vowel = F.regexp_extract(lemma, "^(.*?)(au|[aou])([^aou]*)$", 2)
    head, tail = (F.regexp_extract(lemma, "^(.*?)(au|[aou])([^aou]*)$", i) for i in (1, 3))
    changed = F.when(vowel == "au", F.lit("äu")).otherwise(F.translate(vowel, "aou", "äöü"))
    umlauted = F.when(vowel != "", F.concat(head, changed, tail))

    def of(x: Column) -> list[Column]:
        last, before = F.lower(F.substr(x, F.length(x), F.lit(1))), F.lower(F.substr(x, F.greatest(F.length(x) - 1, F.lit(1)), F.lit(1)))
        double = (F.length(x) >= 2) & (last == before) & ~last.isin(*"aeiouäöü")
        return [x, *[F.concat(x, F.lit(e)) for e in PLURALS], F.when(x.endswith("e") | ~double, F.concat(x, F.lit("n"))), F.when(~x.endswith("e") & ~double, F.concat(x, F.lit("en")))]

    return F.array_sort(F.array_distinct(F.filter(F.array(*of(lemma), *of(umlauted)), lambda p: p.isNotNull())))


def phrase_cells(phrases: DataFrame, spark: SparkSession) -> DataFrame:
    """``phrases(id, article, adjective, lemma)`` with each cell that article and adjective both fill: ``(id, family, case, gender, number)``.

    After a definite article adjectives are weak, after "ein" and its like mixed. Phrases without a row disagree. Joins are on forms; the closed
    forms are some hundred rows.
    """
    articles = closed_forms(spark).where("family in ('definite', 'ein')").select(F.col("form").alias("article"), "family", "case", "gender", "number").distinct()
    held = phrases.withColumn("article", F.lower("article")).join(F.broadcast(articles), "article")
    endings = [(("definite" if d == "weak" else "ein"), e, c, g, n) for d in ("weak", "mixed") for e, c, g, n in cells(ADJECTIVE[d])]
    table = spark.createDataFrame(endings, "family string, ending string, case string, gender string, number string")
    held = held.withColumn("ending", F.when(F.lower("adjective").startswith(F.lower("lemma")), F.substr(F.lower("adjective"), F.length("lemma") + 1)))
    return held.join(F.broadcast(table), ["family", "ending", "case", "gender", "number"]).select("id", "family", "case", "gender", "number")
