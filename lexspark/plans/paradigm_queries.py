"""Paradigms over all words of documents: which words are forms of which, and what they can be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.operators import paradigms as P
from lexspark.operators.trees import INSEPARABLE, PREFIXES
from lexspark.plans.tables import read
from lexspark.storage import stored

WORD = r"\p{L}+"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """``(word)``: distinct lower-case words of all documents."""
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    return read(spark, d, "documents").select(tokens.alias("word")).distinct()


def closed_class_readings(spark: SparkSession, d: str) -> DataFrame:
    """Each word of the closed classes with its cells, and how often documents have it."""
    tokens = read(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("form"))
    counted = tokens.groupBy("form").agg(F.count("*").alias("n"))
    held = counted.join(F.broadcast(P.closed_forms(spark)), "form")
    return held.select("form", "n", "family", "lemma", "case", "gender", "number", F.coalesce("person", F.lit("")).alias("person"))


def adjective_readings(spark: SparkSession, d: str) -> DataFrame:
    """For each word that is another word with an adjective's ending: that word, and the cells that the form can fill."""
    words = stored(_words(spark, d).where("length(word) >= 3"))
    forms = P.adjective_forms(words.withColumnRenamed("word", "lemma"))
    return forms.join(words.withColumnRenamed("word", "form"), "form", "left_semi").select("form", "lemma", "cells", "strong", "first_case")


def weak_verb_readings(spark: SparkSession, d: str) -> DataFrame:
    """Words that are finite forms of other words, as weak verbs."""
    words = stored(_words(spark, d))
    return P.conjugated(words.withColumnRenamed("word", "lemma")).join(words.withColumnRenamed("word", "form"), "form", "left_semi").select("lemma", "form", "tense", "person", "number")


def verb_shapes(spark: SparkSession, d: str) -> DataFrame:
    """What the spelling of each word says: participle, infinitive with zu, the infinitives that it can be of. Participles of one in sixteen words are known."""
    words = stored(_words(spark, d))
    known = words.where("substring(md5(word), 1, 1) = '0'").select(F.col("word").alias("participle"), F.concat("word", F.lit("en")).alias("infinitive"))
    held = P.with_participle_infinitives(words, known)
    return held.select("word", P.participle_shape(F.col("word")).alias("participle"), P.zu_infinitive_shape(F.col("word")).alias("zu_infinitive"), F.coalesce("infinitive", F.lit("")).alias("infinitive"), F.array_join(P.weak_infinitives(F.col("word")), " ").alias("weak"))


def noun_plural_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of words of which the second may be the first's plural."""
    words = stored(_words(spark, d))
    return words.select(F.col("word").alias("lemma"), F.explode(P.noun_plurals(F.col("word"))).alias("word")).join(words, "word", "left_semi").select("lemma", F.col("word").alias("plural"))


def phrase_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Article, adjective as its stem and an ending, for all word pairs after an article: in how many cells they agree, 0 for none."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    held = read(spark, d, "documents").where("doc_id is not null").select("doc_id", F.posexplode(tokens).alias("at", "article"))
    after = F.lead("article").over(Window.partitionBy("doc_id").orderBy("at"))
    pairs = held.withColumn("adjective", after).where("adjective is not null").join(F.broadcast(P.closed_forms(spark).where("family in ('definite', 'ein')").select(F.col("form").alias("article")).distinct()), "article", "left_semi")
    distinct = pairs.groupBy("article", "adjective").agg(F.count("*").alias("n"))
    distinct = stored(distinct.withColumn("lemma", F.regexp_replace("adjective", "e[nmrs]?$", "")).withColumn("id", F.concat_ws(" ", "article", "adjective")))
    found = P.phrase_cells(distinct, spark).groupBy("id").agg(F.count("*").alias("cells"))
    return distinct.join(found, "id", "left").select("article", "adjective", "n", F.coalesce("cells", F.lit(0)).alias("cells"))


QUERIES = {f.__name__: f for f in (closed_class_readings, adjective_readings, weak_verb_readings, verb_shapes, noun_plural_pairs, phrase_agreement)}


def _q(x) -> str:
    return "NULL" if x is None else f"'{x}'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)


def _any(test: str, values) -> str:
    return "(" + " OR ".join(test.format(v, len(v)) for v in values) + ")"


_BASE = rf"WITH words AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents)"
_STEM = "CASE WHEN ends_with({x}, 'en') AND length({x}) > 3 THEN left({x}, length({x}) - 2) WHEN ends_with({x}, 'n') AND length({x}) > 2 THEN left({x}, length({x}) - 1) END"
_DENTAL = "(ends_with({s}, 'd') OR ends_with({s}, 't'))"
_END = "(ends_with({x}, 't') OR (ends_with({x}, 'en') AND length({x}) > 2))"
_LONGEST = sorted(PREFIXES, key=lambda p: (-len(p), p))
_REST = "CASE " + " ".join(f"WHEN starts_with(word, '{p}') AND length(word) > {len(p)} THEN substr(word, {len(p) + 1})" for p in _LONGEST) + " END"
_INSEPARABLE = _any("(starts_with(word, '{0}') AND length(word) > {1})", INSEPARABLE)
_UNDO = "CASE WHEN ends_with({x}, 'et') AND length({x}) > 2 AND regexp_matches({x}, '[dt]et$') THEN left({x}, length({x}) - 2) || 'en' WHEN ends_with({x}, 't') AND length({x}) > 1 THEN left({x}, length({x}) - 1) || 'en' END"
_FORMS = " UNION ALL ".join(
    f"SELECT lemma, CASE {extra} ELSE s || '{e}' END AS form, 'Pres' AS tense, '{p}' AS person, '{n}' AS number FROM st"
    for (p, n), e in zip(P.FINITE, P.PRESENT)
    for extra in ["WHEN regexp_matches(s, '[szx]$') THEN s || 't' WHEN regexp_matches(s, '[dt]$') THEN s || 'est'" if (p, n) == ("2", "Sing") else "WHEN regexp_matches(s, '[dt]$') THEN s || 'et'" if (p, n) in {("3", "Sing"), ("2", "Plur")} else "WHEN false THEN ''"]
) + " UNION ALL " + " UNION ALL ".join(f"SELECT lemma, s || CASE WHEN regexp_matches(s, '[dt]$') THEN 'e' ELSE '' END || '{e}', 'Past', '{p}', '{n}' FROM st" for (p, n), e in zip(P.FINITE, P.PAST))
_PLURALS = "[{x}, {x} || 'e', {x} || 'er', {x} || 's'] || CASE WHEN ends_with({x}, 'e') OR NOT {d} THEN [{x} || 'n'] ELSE [] END || CASE WHEN NOT ends_with({x}, 'e') AND NOT {d} THEN [{x} || 'en'] ELSE [] END"
_DOUBLE = "(length({x}) >= 2 AND right({x}, 1) = left(right({x}, 2), 1) AND right({x}, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'ä', 'ö', 'ü'))"


def _plurals(x: str) -> str:
    return _PLURALS.replace("{d}", _DOUBLE).replace("{x}", x)


_CLOSED = f"closed(family, lemma, form, kase, gender, number, person) AS (VALUES {_rows(P.closed_rows())})"
_ENDINGS = f"endings(declension, ending, kase, gender, number) AS (VALUES {_rows((d, *c) for d, t in P.ADJECTIVE.items() for c in P.cells(t))})"
ORACLES = {
    "closed_class_readings": rf"""WITH toks AS (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS form FROM documents), c AS (SELECT form, count(*) AS n FROM toks GROUP BY form), {_CLOSED}
SELECT form, n, family, lemma, kase AS "case", gender, number, coalesce(person, '') AS person FROM c JOIN closed USING (form)""",
    "adjective_readings": f"""{_BASE}, {_ENDINGS}, l AS (SELECT word FROM words WHERE length(word) >= 3) SELECT f.word AS form, l.word AS lemma, count(*) AS cells, count(*) FILTER (declension = 'strong') AS strong, min(kase) AS first_case
FROM (SELECT w.word, e.declension, e.kase, left(w.word, length(w.word) - length(e.ending)) AS base FROM l w, endings e WHERE ends_with(w.word, e.ending)) f JOIN l ON l.word = f.base GROUP BY ALL""",
    "weak_verb_readings": f"{_BASE}, st AS (SELECT word AS lemma, {_STEM.replace('{x}', 'word')} AS s FROM words WHERE {_STEM.replace('{x}', 'word')} IS NOT NULL), forms AS ({_FORMS}) SELECT lemma, form, tense, person, number FROM forms WHERE form IN (SELECT word FROM words)",
    "verb_shapes": f"""{_BASE}, k AS (SELECT word AS participle, word || 'en' AS infinitive FROM words WHERE substr(md5(word), 1, 1) = '0'), r AS (SELECT word, {_REST} AS rest FROM words),
w AS (SELECT word, rest, coalesce(starts_with(rest, 'ge') AND {_END.replace("{x}", "rest")}, false) AS fits, CASE WHEN ends_with(word, 't') AND length(word) >= 3 THEN list_filter([left(word, length(word) - 1) || 'en'] || CASE WHEN ends_with(word, 'et') AND length(word) > 3 THEN [left(word, length(word) - 2) || 'en'] ELSE [] END,
  lambda c: CASE WHEN regexp_matches(left(c, length(c) - 2), '[dt]$') THEN left(c, length(c) - 2) || 'et' ELSE left(c, length(c) - 2) || 't' END = word) ELSE [] END AS weak FROM r)
SELECT word, NOT coalesce(starts_with(rest, 'zu') AND length(rest) > 2, false) AND (fits OR (starts_with(word, 'ge') AND {_END.replace("{x}", "word")}) OR ({_INSEPARABLE} AND ends_with(word, 't'))) AS participle,
  {_any("(starts_with(word, '{0}zu') AND length(word) > {1} + 2)", P.ZU_PREFIXES)} AS zu_infinitive,
  coalesce(a.infinitive, CASE WHEN fits THEN left(word, length(word) - length(rest)) || coalesce(b.infinitive, {_UNDO.replace("{x}", "substr(rest, 3)")}) WHEN starts_with(word, 'ge') AND {_END.replace("{x}", "word")} THEN {_UNDO.replace("{x}", "substr(word, 3)")}
    WHEN {_INSEPARABLE} AND ends_with(word, 't') THEN {_UNDO.replace("{x}", "word")} END, '') AS infinitive, array_to_string(list_sort(list_distinct(weak)), ' ') AS weak
FROM w LEFT JOIN k a ON a.participle = word LEFT JOIN k b ON b.participle = rest AND fits""",
    "noun_plural_pairs": rf"""{_BASE}, u AS (SELECT word, regexp_extract(word, '^(.*?)(au|[aou])([^aou]*)$', ['h', 'v', 't']) AS g FROM words),
v AS (SELECT word, CASE WHEN g.v <> '' THEN g.h || CASE g.v WHEN 'au' THEN 'äu' ELSE translate(g.v, 'aou', 'äöü') END || g.t END AS um FROM u),
p AS (SELECT word AS lemma, unnest(list_distinct({_plurals("word")} || CASE WHEN um IS NULL THEN [] ELSE {_plurals("um")} END)) AS plural FROM v) SELECT lemma, plural FROM p WHERE plural IN (SELECT word FROM words)""",
    "phrase_agreement": rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL), x AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM t), {_CLOSED}, {_ENDINGS},
arts AS (SELECT DISTINCT form, family, kase, gender, number FROM closed WHERE family IN ('definite', 'ein')), pairs AS (SELECT w[i] AS article, w[i + 1] AS adjective, count(*) AS n FROM x WHERE w[i] IN (SELECT form FROM arts) GROUP BY ALL),
stems AS (SELECT *, regexp_replace(adjective, 'e[nmrs]?$', '') AS lemma FROM pairs),
hits AS (SELECT s.article, s.adjective, count(*) AS cells FROM stems s JOIN arts a ON a.form = s.article JOIN endings e ON e.ending = substr(s.adjective, length(s.lemma) + 1) AND e.kase = a.kase AND e.gender = a.gender AND e.number = a.number
  AND e.declension = CASE a.family WHEN 'definite' THEN 'weak' ELSE 'mixed' END GROUP BY ALL)
SELECT article, adjective, n, coalesce(cells, 0) AS cells FROM stems LEFT JOIN hits USING (article, adjective)""",
}
