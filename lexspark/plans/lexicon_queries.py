"""Lexicon and ceilings over all words and sentences of documents; the lists are drawn from their words by hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import lexicon as L
from lexspark.operators.ranking import ranked
from lexspark.operators.trees import PREFIXES
from lexspark.plans.tables import LINES, lines
from lexspark.storage import stored

CEILING = 2


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents, and facts of their words: three of eight words have a level, one in sixteen an irregular lemma, few are function words or names."""
    held = stored(lines(spark, d).select("line_id", "text"))
    counted = stored(L.sentence_words(held).groupBy("word").agg(F.count("*").alias("n")))
    digit = lambda at: F.conv(F.substring(F.md5("word"), at, 1), 16, 10).cast("int")
    vocabulary = counted.where(digit(1) < 6).select("word", (digit(2) % 4 + 1).alias("level"))
    irregular = counted.where(digit(1) == 15).select(F.col("word").alias("form"), F.concat(F.expr("left(word, length(word) - 1)"), F.lit("en")).alias("lemma"))
    function, names = counted.where((digit(1) == 14) & (digit(2) < 4)), counted.where((digit(1) == 14) & (digit(2) >= 12))
    ranks = ranked(counted, [-F.col("n"), F.col("word")]).select("word", (F.col("rank") * 20).alias("rank"))
    return held, stored(L.word_facts(counted, vocabulary, irregular, function, names, ranks))


def lemma_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of all words, numbered in their order."""
    words = stored(L.sentence_words(lines(spark, d).select("line_id", "text")).select("word").distinct())
    irregular = words.where("substring(md5(word), 1, 1) = 'f'").select(F.col("word").alias("form"), F.concat(F.expr("left(word, length(word) - 1)"), F.lit("en")).alias("lemma"))
    found = L.lemma_candidates(words, irregular).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "candidate"))).alias("c"))  # some dozens a word
    return found.select("word", F.array_join(F.transform("c", lambda x: x["candidate"]), " ").alias("candidates"))


def word_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of each word, 0 where nothing tells one."""
    return L.word_level(_tables(spark, d)[1]).select("word", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def ceiling_checks(spark: SparkSession, d: str) -> DataFrame:
    held, facts = _tables(spark, d)
    told = L.ceiling_check(held, facts, CEILING)
    return told.select("line_id", *[F.array_join(c, " ").alias(c) for c in ("violations", "over_budget", "unknown")])


def words_within(spark: SparkSession, d: str) -> DataFrame:
    """How often each word is within the ceiling and above it; a separated prefix can make the difference."""
    held, facts = _tables(spark, d)
    words = L.sentence_words(held).groupBy("word", "prefixes").agg(F.count("*").alias("n"))  # all that decides, so that equal words meet their facts once
    told = L.within_ceiling(words, facts, CEILING)
    return told.groupBy("word").agg(F.sum(F.when(F.col("within"), F.col("n")).otherwise(0)).alias("within"), F.sum(F.when(F.col("within"), 0).otherwise(F.col("n"))).alias("above"))


QUERIES = {f.__name__: f for f in (lemma_candidates, word_levels, ceiling_checks, words_within)}


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_STRIP = "list_transform(list_filter({ends}, lambda e: ends_with({x}, e) AND length({x}) - length(e) >= 3), lambda e: left({x}, length({x}) - length(e)))".replace("{ends}", _list(L.ENDINGS))
_ACTIVE = "CASE WHEN ends_with({x}, 'd') AND length({x}) >= 4 THEN [left({x}, length({x}) - 1)] ELSE [] END"
_WORDS = rf"""WITH {LINES},
toks AS (SELECT line_id, unnest(range(0, len(t))) AS at_, unnest(t) AS token, list_filter(list_transform(list_filter(t, lambda x: regexp_matches(x, '{L.LETTERS}')), lambda x: replace(lower(x), 'ß', 'ss')), lambda x: list_contains({_list(PREFIXES)}, x)) AS prefixes
  FROM (SELECT line_id, regexp_extract_all(text, '{L.TOKEN}') AS t FROM lines)),
sw AS MATERIALIZED (SELECT *, replace(lower(token), 'ß', 'ss') AS word FROM toks WHERE regexp_matches(token, '{L.CONTENT}')),
c AS MATERIALIZED (SELECT word, count(*) AS n, CAST('0x' || substr(md5(word), 1, 1) AS INTEGER) AS d1, CAST('0x' || substr(md5(word), 2, 1) AS INTEGER) AS d2 FROM sw GROUP BY word),
irr AS MATERIALIZED (SELECT word AS form, left(word, length(word) - 1) || 'en' AS lemma FROM c WHERE d1 = 15),
rt AS (SELECT word, substr(word, 3) AS core, starts_with(word, 'ge') AND length(word) > 5 AS part FROM c),
roots AS (SELECT word, list_distinct([word] || CASE WHEN part THEN [core] || CASE WHEN ends_with(core, 'et') AND length(core) >= 5 THEN [left(core, length(core) - 2)] WHEN ends_with(core, 't') AND length(core) >= 4 THEN [left(core, length(core) - 1)] ELSE [] END ELSE [] END) AS r FROM rt),
r1 AS (SELECT word, unnest(r) AS x FROM roots),
s1 AS (SELECT word, unnest([x] || {_STRIP.replace("{x}", "x")} || {_ACTIVE.replace("{x}", "x")}) AS x FROM r1),
s2 AS (SELECT DISTINCT word, unnest([x] || {_ACTIVE.replace("{x}", "x")}) AS stem FROM s1),
st AS MATERIALIZED (SELECT word, stem, CASE WHEN stem = word THEN 0 ELSE row_number() OVER (PARTITION BY word ORDER BY stem = word, length(stem) DESC, stem) END AS nr, translate(stem, 'äöü', 'aou') AS plain FROM s2),
cand AS MATERIALIZED (SELECT word, x AS candidate, min(p) AS place FROM (
  SELECT word, stem AS x, nr * 6 AS p FROM st UNION ALL SELECT word, stem || 'en', nr * 6 + 1 FROM st WHERE NOT ends_with(stem, 'en') AND length(stem) >= 3
  UNION ALL SELECT word, lemma, nr * 6 + 2 FROM st JOIN irr ON form = stem UNION ALL SELECT word, plain, nr * 6 + 3 FROM st WHERE plain <> stem
  UNION ALL SELECT word, plain || 'en', nr * 6 + 4 FROM st WHERE plain <> stem AND NOT ends_with(plain, 'en') AND length(plain) >= 3 UNION ALL SELECT word, lemma, nr * 6 + 5 FROM st JOIN irr ON form = plain WHERE plain <> stem) GROUP BY ALL)"""
_FACTS = (
    _WORDS
    + f""",
vocab AS MATERIALIZED (SELECT word, d2 % 4 + 1 AS level FROM c WHERE d1 < 6),
hits AS (SELECT k.word, arg_min(level, place) AS first, min(level) AS easiest FROM cand k JOIN vocab v ON v.word = k.candidate GROUP BY k.word),
prefixed AS MATERIALIZED (SELECT prefix, substr(word, length(prefix) + 1) AS rest, level FROM vocab, (SELECT unnest({_list(PREFIXES)}) AS prefix) WHERE starts_with(word, prefix)),
apart AS MATERIALIZED (SELECT k.word, p.prefix, min(level) AS level FROM cand k JOIN prefixed p ON p.rest = k.candidate WHERE ends_with(candidate, 'en') AND length(candidate) >= 4 GROUP BY ALL),
direct AS (SELECT word, CASE WHEN d1 = 14 THEN 1 ELSE d2 % 4 + 1 END AS level FROM c WHERE d1 < 6 OR (d1 = 14 AND d2 < 4)),
cuts AS (SELECT word, unnest(range(4, length(word) - 3)) AS k FROM c WHERE length(word) >= 8 AND word NOT IN (SELECT word FROM hits)),
halves AS (SELECT word, left(word, k) AS h, substr(word, k + 1) AS tail FROM cuts),
heads AS (SELECT DISTINCT word, tail, unnest([h] || list_transform(list_filter({_list(L.LINKS)}, lambda e: ends_with(h, e) AND length(h) - length(e) >= 4), lambda e: left(h, length(h) - length(e)))) AS head FROM halves),
comp AS (SELECT x.word, min(greatest(a.level, b.level)) AS compound FROM heads x JOIN direct a ON a.word = x.head JOIN direct b ON b.word = x.tail GROUP BY x.word),
ranks AS (SELECT word, 20 * row_number() OVER (ORDER BY n DESC, word) AS rank FROM c),
facts AS MATERIALIZED (SELECT c.word, first, easiest, compound, CASE WHEN rank < 5000 THEN 1 WHEN rank < 10000 THEN 2 WHEN rank < 20000 THEN 3 WHEN rank < 50000 THEN 4 ELSE 5 END AS fallback, d1 = 14 AND d2 < 4 AS is_function, d1 = 14 AND d2 >= 12 AS is_name
  FROM c LEFT JOIN hits USING (word) LEFT JOIN comp USING (word) LEFT JOIN ranks USING (word)),
own AS MATERIALIZED (SELECT s.line_id, s.at_, s.token, s.word, is_function, is_name, fallback, coalesce(least(easiest, a.level), compound) AS own FROM sw s JOIN facts f USING (word)
  LEFT JOIN (SELECT line_id, at_, min(a.level) AS level FROM (SELECT line_id, at_, word, unnest(prefixes) AS prefix FROM sw) x JOIN apart a USING (word, prefix) GROUP BY ALL) a USING (line_id, at_))"""
)
ORACLES = {
    "lemma_candidates": _WORDS + " SELECT word, string_agg(candidate, ' ' ORDER BY place) AS candidates FROM cand GROUP BY word",
    "word_levels": _FACTS + " SELECT word, CAST(CASE WHEN is_function THEN 1 ELSE coalesce(first, compound, 0) END AS INTEGER) AS level FROM facts",
    "ceiling_checks": _FACTS
    + f""", b AS (SELECT *, coalesce(own, fallback) - {CEILING} AS above FROM own WHERE NOT is_function AND NOT is_name),
g AS (SELECT line_id, string_agg(token, ' ' ORDER BY at_) FILTER (above >= 2) AS hard, string_agg(token, ' ' ORDER BY at_) FILTER (above = 1) AS over, count(*) FILTER (above = 1) AS n, string_agg(token, ' ' ORDER BY at_) FILTER (own IS NULL) AS none FROM b GROUP BY line_id)
SELECT line_id, concat_ws(' ', hard, CASE WHEN n > {L.ONE_ABOVE} THEN over END) AS violations, coalesce(over, '') AS over_budget, coalesce(none, '') AS unknown FROM lines LEFT JOIN g USING (line_id)""",
    "words_within": _FACTS + f" SELECT word, count(*) FILTER (ok) AS within, count(*) FILTER (NOT ok) AS above FROM (SELECT word, is_function OR is_name OR own IS NULL OR own <= {CEILING} AS ok FROM own) GROUP BY word",
}
