"""The driver's tables as the library's inputs, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import corpus

#: Sources whose register counts as everyday speech.
EVERYDAY = ["src0", "src1", "src2", "src3"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.plausible_sentences(read(spark, sf_dir, "documents"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(learner, seq, ts, type, unit, rating)`` of events: errors are again, clicks hard, views good, purchases easy, signups resets."""
    kind = F.col("event_type")
    rating = F.when(kind == "error", 1).when(kind == "click", 2).when(kind == "view", 3).when(kind == "purchase", 4)
    unit = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("learner"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(kind == "signup", "reset").otherwise("review").alias("type"), unit.alias("unit"), rating.alias("rating"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("rating is not null and unit is not null")


LINES = r"""
sent AS (
  SELECT source, doc_id || '#' || pos AS line_id, doc_id, pos, text FROM (
    SELECT source, doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS text FROM (
      SELECT source, doc_id, list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x)) AS s FROM documents)) WHERE text <> ''
), lines AS (
  SELECT * FROM sent WHERE length(text) BETWEEN 25 AND 160 AND regexp_matches(text, '[.!?]$')
    AND len(string_split_regex(trim(text), '\s+')) BETWEEN 5 AND 18 AND NOT regexp_matches(text, '[|<>\[\]{}\t]')
)"""

LOG = r"""
log AS (
  SELECT user_id AS learner, event_id AS seq, ts, CASE WHEN event_type = 'signup' THEN 'reset' ELSE 'review' END AS type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS unit,
         CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 WHEN 'purchase' THEN 4 END AS rating
  FROM events
), reviews AS (SELECT * FROM log WHERE rating IS NOT NULL AND unit IS NOT NULL)"""
