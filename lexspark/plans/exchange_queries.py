"""Joins of the exchange between devices and corpora over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.plans.tables import LINES, LOG, lines, reviews
from lexspark.sources import exchange

OWNER = "src0"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of events, and corrections of those whose number is divisible by five (to again) or by seven (to good, written later)."""
    held = reviews(spark, d).select("learner", F.lit("review").alias("type"), F.col("unit").cast("string").alias("unit_id"), "ts", "seq", "rating", F.lit(None).cast("timestamp").alias("review_ts"))
    after = lambda n, hours, rating: held.where(F.col("seq") % n == 0).select("learner", F.lit("correction").alias("type"), "unit_id", F.timestamp_micros(F.unix_micros("ts") + hours * 3_600_000_000).alias("ts"), "seq", F.lit(rating).alias("rating"), F.col("ts").alias("review_ts"))
    return held.union(after(5, 1, 1)).union(after(7, 2, 3))


def corrected_reviews(spark: SparkSession, d: str) -> DataFrame:
    """How often each learner gave each rating, as corrected."""
    return exchange.corrected(_entries(spark, d)).groupBy("learner", "rating").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def corrected_streaks(spark: SparkSession, d: str) -> DataFrame:
    """The last rating of each unit after corrections, counted by learner: a correction that comes in late changes it too."""
    held = exchange.corrected(_entries(spark, d)).groupBy("learner", "unit_id").agg(F.max_by("rating", F.struct("ts", "seq")).alias("rating"))
    return held.groupBy("learner").agg(F.count_if(F.col("rating") == 1).alias("again"), F.count_if(F.col("rating") > 1).alias("held"))


def paired_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all corpora with glosses from pairs that the first corpus has, its lines being numbered by their place in a document as others are too; guarded."""
    held = lines(spark, d).select("source", F.substring_index("line_id", "#", -1).alias("line_id"), "text")
    pairs = held.where((F.col("source") == OWNER) & (F.length("text") % 3 == 0)).select(F.col("line_id").alias("id"), F.col("text").alias("german"), F.upper(F.substring("text", 1, 12)).alias("english"))
    glossed = exchange.guard(exchange.paired_glosses(held, pairs, OWNER), pairs, OWNER)
    return glossed.groupBy("source").agg(F.count("*").alias("n"), F.count("english").alias("glossed"), F.min("english").alias("first"))


QUERIES = {f.__name__: f for f in (corrected_reviews, corrected_streaks, paired_lines)}

_ENTRIES = rf"""WITH {LOG}, c AS (SELECT learner, unit, ts AS review_ts, seq, ts + INTERVAL 1 HOUR AS ts, 1 AS rating FROM reviews WHERE seq % 5 = 0 UNION ALL SELECT learner, unit, ts, seq, ts + INTERVAL 2 HOUR, 3 FROM reviews WHERE seq % 7 = 0),
told AS (SELECT learner, unit, review_ts AS ts, arg_max(rating, (ts, seq)) AS new FROM c GROUP BY ALL), e AS (SELECT r.learner, r.unit, r.ts, r.seq, coalesce(new, rating) AS rating FROM reviews r LEFT JOIN told USING (learner, unit, ts))"""
ORACLES = {
    "corrected_reviews": _ENTRIES + " SELECT learner, rating, count(*) AS n, max(seq) AS last_seq FROM e GROUP BY ALL",
    "corrected_streaks": _ENTRIES + " SELECT learner, count(*) FILTER (rating = 1) AS again, count(*) FILTER (rating > 1) AS held FROM (SELECT learner, unit, arg_max(rating, (ts, seq)) AS rating FROM e GROUP BY ALL) GROUP BY learner",
    "paired_lines": rf"""WITH {LINES}, l AS (SELECT source, CAST(pos AS VARCHAR) AS line_id, text FROM lines), p AS (SELECT line_id AS id, text AS german, upper(left(text, 12)) AS english FROM l WHERE source = '{OWNER}' AND length(text) % 3 = 0),
i AS (SELECT id, arg_min(english, (length(english), english)) AS english FROM p GROUP BY id), t AS (SELECT german, arg_min(english, (length(english), english)) AS english FROM p GROUP BY german),
g AS (SELECT l.source, coalesce(CASE WHEN l.source = '{OWNER}' THEN i.english END, t.english) AS english FROM l LEFT JOIN i ON i.id = l.line_id LEFT JOIN t ON t.german = l.text)
SELECT source, count(*) AS n, count(english) AS glossed, min(english) AS first FROM g GROUP BY source""",
}
