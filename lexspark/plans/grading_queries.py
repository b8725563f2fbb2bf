"""Queries over answers: words of the corpus as accepted forms, and what is typed for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import families, ngrams
from lexspark.operators import grading as G
from lexspark.plans.tables import LINES, lines
from lexspark.storage import stored


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Each common word typed in five ways: right, capitalised, with a letter too few, with two letters swapped, with another ending."""
    words = stored(ngrams.vocabulary(lines(spark, d), 5_000).where(F.col("word").rlike("^[b-df-hj-np-z][a-z]{5,}$")))
    w = F.col("word")
    typed = F.array(w, F.initcap(w), F.concat(F.substring(w, 1, 1), F.substr(w, F.lit(3))), F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substr(w, F.lit(4))), F.concat(w, F.lit("x")))
    return words.select("word", F.posexplode(typed).alias("way", "typed")).select(F.concat_ws(":", "word", "way").alias("id"), "typed", "way", F.array("word").alias("accepted"))


def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    return G.graded(_answers(spark, d)).select("id", "typed", "outcome")


def rated_words(spark: SparkSession, d: str) -> DataFrame:
    """Words as cards of five gaps."""
    held = G.graded(_answers(spark, d).where("way <> 1 or word < 'm'"))
    return G.card_ratings(held.select(F.substring_index("id", ":", 1).alias("card"), "outcome"))


def word_forms(spark: SparkSession, d: str) -> DataFrame:
    """All words of the corpus with their other forms."""
    words = stored(families.distinct_words(lines(spark, d)))
    return families.inflected_pairs(words)


def _graded_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Each word of four letters or more as a unit of one gap, typed with one letter too few, as a participle, in capitals and not at all."""
    words = stored(families.distinct_words(lines(spark, d)).where(F.length("word") >= 4).select("word")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # little data, much work
    units = words.select(F.col("word").alias("unit_id"), F.array("word").alias("parts"))
    cards = words.select(F.col("word").alias("unit_id"), F.array("word").alias("answers"))
    w = F.col("word")
    typed = F.array(F.concat(F.substring(w, 1, 1), F.substr(w, F.lit(3))), F.concat(F.lit("ge"), w), F.upper(w), F.lit(None))
    gaps = words.select(F.col("word").alias("card"), F.posexplode(typed).alias("pos", "typed"), F.col("word").alias("answer"), F.lit(4).alias("start"), F.lit(4).alias("n_gaps"), F.lit("Inf").alias("form_key"), F.array().cast("array<string>").alias("alternatives"), F.array("word").alias("own"), G.content_words(F.array("word")).alias("parts"))
    return G.gap_grades(gaps, G.deck_words(units, cards))


def gap_grades(spark: SparkSession, d: str) -> DataFrame:
    return _graded_gaps(spark, d).select("card", "pos", "typed", "outcome", "accepted", "near")


def card_grades(spark: SparkSession, d: str) -> DataFrame:
    return G.card_grades(_graded_gaps(spark, d).where("pos < 3").select("card", "outcome"))


QUERIES = {f.__name__: f for f in (graded_answers, rated_words, word_forms, gap_grades, card_grades)}

_ANSWERS = rf"""WITH {LINES}, words AS (
  SELECT replace(w, 'ß', 'ss') AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM lines) GROUP BY 1 ORDER BY n DESC, word LIMIT 5000
), v AS (SELECT word FROM words WHERE regexp_matches(word, '^[b-df-hj-np-z][a-z]{{5,}}$')),
a AS (
  SELECT word, way, word || ':' || way AS id, CASE way WHEN 0 THEN word WHEN 1 THEN upper(word[1]) || substr(word, 2) WHEN 2 THEN word[1] || substr(word, 3)
    WHEN 3 THEN word[1] || word[3] || word[2] || substr(word, 4) ELSE word || 'x' END AS typed FROM v, (VALUES (0), (1), (2), (3), (4)) AS t(way)
), spelled AS (SELECT *, replace(replace(replace(typed, 'ae', 'ä'), 'oe', 'ö'), 'ue', 'ü') AS s, replace(replace(replace(word, 'ae', 'ä'), 'oe', 'ö'), 'ue', 'ü') AS f FROM a),
g AS (
  SELECT *, CASE WHEN typed = word THEN 'exact' WHEN lower(s) = lower(f) THEN CASE WHEN s = f THEN 'spelling' ELSE 'case' END
    WHEN lower(typed) = lower(word) THEN 'case' WHEN way IN (2, 3) THEN 'slip' ELSE 'wrong' END AS outcome FROM spelled
)"""

_ENDINGS = ", ".join(f"('{e}')" for e in ("", "e", "em", "en", "er", "ern", "es", "et", "n", "s", "st", "t", "te", "ten"))

ORACLES = {
    "word_forms": rf"""WITH {LINES}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM lines),
f AS (SELECT word, replace(translate(word, 'äöü', 'aou'), 'ß', 'ss') AS folded FROM w),
s AS (SELECT word, folded, replace(translate(left(word, length(word) - length(e)), 'äöü', 'aou'), 'ß', 'ss') AS stem FROM f, (VALUES {_ENDINGS}) AS t(e) WHERE e = '' OR (suffix(word, e) AND length(word) >= 3 + length(e))),
n AS (SELECT a.word, b.word AS form FROM w a JOIN w b ON b.word IN (a.word || 'se', a.word || 'sen') WHERE suffix(a.word, 'nis'))
SELECT a.word, b.word AS form FROM s a JOIN s b ON a.stem = b.stem AND a.folded <> b.folded UNION SELECT word, form FROM n UNION SELECT form, word FROM n""",
    "graded_answers": f"{_ANSWERS} SELECT id, typed, outcome FROM g",
    "rated_words": f"""{_ANSWERS} SELECT word AS card, CASE max(CASE outcome WHEN 'exact' THEN 0 WHEN 'spelling' THEN 0 WHEN 'slip' THEN 1 WHEN 'case' THEN 2 ELSE 3 END) WHEN 0 THEN 'good' WHEN 1 THEN 'hard' ELSE 'again' END AS rating
FROM g WHERE way <> 1 OR word < 'm' GROUP BY word""",
}
