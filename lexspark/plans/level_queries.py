"""Queries over levels: words and sentences by frequency, units by stability and due day, glosses with a false source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import corpus, families, levels, ngrams
from lexspark.operators import replay as R
from lexspark.operators.ranking import ranked
from lexspark.plans.log_queries import NOW, _now, _states
from lexspark.plans.tables import LINES, lines, read, reviews
from lexspark.storage import stored

#: Words that count as frequent.
FREQUENT = 5_000
#: The source whose label is put to the test, and where its texts may be.
CLAIMED, PAIRED = "src0", "src1"


def word_bands(spark: SparkSession, d: str) -> DataFrame:
    """How many words, and how many of their occurrences, each level has; ranks by count, then by word."""
    words = stored(families.distinct_words(lines(spark, d)))
    held = ranked(words, [-F.col("n"), F.col("word")]).withColumn("band", levels.frequency_band(F.col("rank") - 1))
    return held.groupBy("band").agg(F.count("*").alias("words"), F.sum("n").alias("occurrences"))


def sentence_tiers(spark: SparkSession, d: str) -> DataFrame:
    held = stored(lines(spark, d).select("line_id", "text"))
    return levels.difficulty_tiers(held, stored(ngrams.vocabulary(held, FREQUENT)))


def stability_bands(spark: SparkSession, d: str) -> DataFrame:
    held = R.unit_states(reviews(spark, d)).select("learner", levels.stability_band(F.col("stability")).alias("band"))
    return held.groupBy("learner", "band").agg(F.count("*").alias("units"))


def due_counts(spark: SparkSession, d: str) -> DataFrame:
    return levels.due_counts(R.unit_states(reviews(spark, d)), _now())


def false_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of one source, held in the carriers of the others, but not in those of the paired one."""
    held = stored(corpus.sentences(read(spark, d, "documents")).select("source", F.col("text").alias("german")))
    store = held.where(F.col("source") == CLAIMED).distinct()
    others = held.where(~F.col("source").isin(CLAIMED, PAIRED))
    return levels.contradictory(store, others, held.where(F.col("source") == PAIRED), CLAIMED).select("german")


QUERIES = {f.__name__: f for f in (word_bands, sentence_tiers, stability_bands, due_counts, false_sources)}

ORACLES = {
    "word_bands": rf"""WITH {LINES}, w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM lines), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c)
SELECT CASE WHEN rank <= 5000 THEN 'A1' WHEN rank <= 10000 THEN 'A2' WHEN rank <= 20000 THEN 'B1' WHEN rank <= 50000 THEN 'B2' ELSE 'above' END AS band, count(*) AS words, CAST(sum(n) AS BIGINT) AS occurrences FROM r GROUP BY 1""",
    "sentence_tiers": rf"""WITH {LINES}, w AS (SELECT line_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS raw FROM lines),
v AS (SELECT replace(raw, 'ß', 'ss') AS word FROM w GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {FREQUENT}),
c AS (SELECT line_id, count(*) FILTER (length(raw) >= 12) AS l, count(*) FILTER (replace(raw, 'ß', 'ss') NOT IN (SELECT word FROM v)) AS r FROM w GROUP BY 1)
SELECT line_id, CAST(CASE WHEN l >= 2 OR r >= 3 THEN 3 WHEN l >= 1 OR r >= 1 THEN 2 ELSE 1 END AS INTEGER) AS tier FROM lines LEFT JOIN c USING (line_id)""",
    "stability_bands": f"""{_states()} SELECT learner, CASE WHEN s < 7 THEN 'fresh' WHEN s < 21 THEN 'young' WHEN s < 90 THEN 'mature' ELSE 'solid' END AS band, count(*) AS units FROM last_of GROUP BY 1, 2""",
    "due_counts": f"""{_states()} SELECT learner, count(*) FILTER (due <= TIMESTAMP '{NOW}') AS now, count(*) FILTER (due < date_trunc('day', TIMESTAMP '{NOW}') + INTERVAL 1 DAY) AS today,
count(*) FILTER (due >= date_trunc('day', TIMESTAMP '{NOW}') + INTERVAL 1 DAY AND due < date_trunc('day', TIMESTAMP '{NOW}') + INTERVAL 2 DAY) AS tomorrow FROM last_of GROUP BY 1""",
    "false_sources": f"""WITH {LINES} SELECT DISTINCT text AS german FROM sent WHERE source = '{CLAIMED}' AND text IN (SELECT text FROM sent WHERE source NOT IN ('{CLAIMED}', '{PAIRED}'))
AND text NOT IN (SELECT text FROM sent WHERE source = '{PAIRED}')""",
}
