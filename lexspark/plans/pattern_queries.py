"""Queries over curated patterns: pairs of words of benchmark passages, looked for in all sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import patterns as P
from lexspark.plans.tables import LINES, lines, read


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """The first two and the first three words of each passage; two words may have one between them."""
    w = X.letter_tokens(F.col("text"))
    held = read(spark, d, "benchmark").select(w.alias("w")).where(F.size("w") >= 3)
    two = held.select(F.slice("w", 1, 2).alias("words"), F.lit(1).alias("max_gap"))
    three = held.select(F.slice("w", 1, 3).alias("words"), F.lit(0).alias("max_gap"))
    return two.union(three).distinct().select(F.array_join("words", " ").alias("key"), "words", "max_gap", F.array(F.lit("zzz")).alias("unless"))


def pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    return P.pattern_hits(lines(spark, d), _patterns(spark, d)).select("key", "line_id", F.array_join("places", ",").alias("places"))


def longest_patterns(spark: SparkSession, d: str) -> DataFrame:
    held = P.longest_hits(P.pattern_hits(lines(spark, d), _patterns(spark, d)))
    return held.groupBy("key").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pattern_hits, longest_patterns)}

_HITS = rf"""WITH {LINES}, b AS (SELECT regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM benchmark), p AS (
  SELECT DISTINCT array_to_string(w[1 : 2], ' ') AS key, w[1] AS a, w[2] AS b, NULL AS c FROM b WHERE len(w) >= 3 UNION SELECT DISTINCT array_to_string(w[1 : 3], ' '), w[1], w[2], w[3] FROM b WHERE len(w) >= 3
), t AS (SELECT line_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM lines), e AS (SELECT line_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
h AS (
  SELECT key, line_id, i - 1 AS x, CASE WHEN w[i + 1] = b THEN i ELSE i + 1 END AS y, CASE WHEN c IS NOT NULL THEN i + 1 END AS z FROM e JOIN p ON w[i] = a
  WHERE CASE WHEN c IS NULL THEN w[i + 1] = b OR w[i + 2] = b ELSE w[i + 1] = b AND w[i + 2] = c END AND NOT list_contains(w, 'zzz')
), g AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY key, line_id ORDER BY x, y, z) = 1)"""

ORACLES = {
    "pattern_hits": f"{_HITS} SELECT key, line_id, x || ',' || y || coalesce(',' || z, '') AS places FROM g",
    "longest_patterns": f"""{_HITS} SELECT key, count(*) AS n FROM g a WHERE z IS NOT NULL OR NOT EXISTS (
  SELECT 1 FROM g b WHERE b.line_id = a.line_id AND b.z IS NOT NULL AND a.x IN (b.x, b.y, b.z) AND a.y IN (b.x, b.y, b.z)) GROUP BY key""",
}
