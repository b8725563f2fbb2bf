"""Queries over occurrences: order lines stand in for occurrences, part names for units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import units as U
from lexspark.plans.tables import EVERYDAY, read
from lexspark.storage import stored

KINDS = ["verb_prep", "reflexive_verb", "separable_verb", "noun_verb", "adj_noun", "expression", "connector"]
#: Limits for tables of some ten thousand occurrences.
LIMITS = U.Thresholds(governed_ratio=0.02, governed_lift=0.9, reflexive_share=0.02, pair_lift=0.9, pair_g2=0.1, adjective_count=20, adjective_lift=1.0, carriers=60)


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("key"))
    i = read(spark, d, "lineitem").join(names, "l_partkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.pmod("l_linenumber", F.lit(7)).cast("int") + 1)
    return i.select(
        kind.alias("kind"), "key", F.col("l_orderkey").alias("sentence"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("ord"),
        F.concat(F.lit("src"), F.pmod("l_orderkey", F.lit(9))).alias("source"), (F.col("l_returnflag") == "R").alias("gap"),
        (F.pmod("l_partkey", F.lit(3)) == 0).alias("reflexive"), (F.col("l_linestatus") == "F").alias("initial"),
    )


def unit_tally(spark: SparkSession, d: str) -> DataFrame:
    return U.tally(_occurrences(spark, d), EVERYDAY)


def unit_tally_merged(spark: SparkSession, d: str) -> DataFrame:
    """The tally in two halves of the sentences, merged."""
    held = _occurrences(spark, d)
    return U.merged(U.tally(held.where("sentence % 2 = 0"), EVERYDAY), U.tally(held.where("sentence % 2 = 1"), EVERYDAY))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    held = _occurrences(spark, d)
    t = stored(U.tally(held, EVERYDAY))
    part = lambda i: F.element_at(F.split("key", " "), i)
    words = U.first_in_sentence(held).select("kind", "sentence", F.explode(F.split("key", " ")).alias("w")).groupBy("kind", "w").agg(F.countDistinct("sentence").alias("c"))
    words = stored(words)
    total = held.agg(F.countDistinct("sentence").alias("total"))
    t = t.join(words.select("kind", F.col("w").alias("a"), F.col("c").alias("n_a")), (t["kind"] == words["kind"]) & (F.col("a") == part(1))).drop(words["kind"]).drop("a")
    other = words.select(F.col("kind").alias("k"), F.col("w").alias("b"), F.col("c").alias("n_b"))
    t = t.join(other, (F.col("kind") == F.col("k")) & (F.col("b") == part(2))).drop("k", "b").crossJoin(F.broadcast(total))
    length = F.length("key")
    return t.withColumns({"listed": part(2) != "widget", "seeded": length % 5 == 0, "requested": length % 7 == 0, "excluded": length % 11 == 0})


def unit_decisions(spark: SparkSession, d: str) -> DataFrame:
    return U.decided(_stats(spark, d), LIMITS).select("kind", "key", "n", "accept", F.coalesce("reason", F.lit("-")).alias("reason"), "origin")


def decision_report(spark: SparkSession, d: str) -> DataFrame:
    return U.report(U.decided(_stats(spark, d), LIMITS)).select("kind", F.coalesce("reason", F.lit("-")).alias("reason"), "n")


def forced_words(spark: SparkSession, d: str) -> DataFrame:
    return U.forced_words(U.decided(_stats(spark, d), LIMITS).where("accept"))


QUERIES = {f.__name__: f for f in (unit_tally, unit_tally_merged, unit_decisions, decision_report, forced_words)}

_TALLY = """WITH o AS (
  SELECT (['verb_prep', 'reflexive_verb', 'separable_verb', 'noun_verb', 'adj_noun', 'expression', 'connector'])[l_linenumber % 7 + 1] AS kind, p_name AS key, l_orderkey AS sentence, l_orderkey * 1000000 + l_partkey AS ord,
    'src' || (l_orderkey % 9) AS source, l_returnflag = 'R' AS gap, l_partkey % 3 = 0 AS reflexive, l_linestatus = 'F' AS initial FROM lineitem JOIN part ON l_partkey = p_partkey
), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY kind, key, sentence ORDER BY ord, source, gap, reflexive, initial) = 1),
t AS (SELECT kind, key, count(*) AS n, count(*) FILTER (source IN ('src0', 'src1', 'src2', 'src3')) AS everyday, count(*) FILTER (gap) AS discontinuous, count(*) FILTER (reflexive) AS reflexive, count(*) FILTER (initial) AS initial, min(ord) AS first FROM f GROUP BY ALL)"""
_T = LIMITS
_DECIDED = f"""{_TALLY}, w AS (SELECT kind, w, count(DISTINCT sentence) AS c FROM (SELECT kind, sentence, unnest(string_split(key, ' ')) AS w FROM f) GROUP BY ALL),
s AS (SELECT t.*, a.c::DOUBLE AS a, b.c::DOUBLE AS b, (SELECT count(DISTINCT sentence) FROM o)::DOUBLE AS total, length(key) AS len, string_split(key, ' ')[2] <> 'widget' AS listed
  FROM t JOIN w a ON t.kind = a.kind AND a.w = string_split(key, ' ')[1] JOIN w b ON t.kind = b.kind AND b.w = string_split(key, ' ')[2]),
m AS (SELECT *, (n / total) / ((a / total) * (b / total)) AS lift,
  CASE WHEN least(a - n, b - n, total - a - b + n) < 0 THEN 0 ELSE 2 * (n * ln(n / (a * b / total)) + CASE WHEN a > n THEN (a - n) * ln((a - n) / (a * (total - b) / total)) ELSE 0 END
    + CASE WHEN b > n THEN (b - n) * ln((b - n) / ((total - a) * b / total)) ELSE 0 END + CASE WHEN total - a - b + n > 0 THEN (total - a - b + n) * ln((total - a - b + n) / ((total - a) * (total - b) / total)) ELSE 0 END) END AS g2 FROM s),
d AS (SELECT *, CASE WHEN len % 11 = 0 THEN 'excluded' WHEN len % 7 = 0 OR len % 5 = 0 THEN '-' ELSE CASE kind
  WHEN 'verb_prep' THEN CASE WHEN reflexive / n >= {_T.reflexive_with_preposition} THEN 'mostly_reflexive' WHEN n < {_T.count} THEN 'count' WHEN n / a < {_T.governed_ratio} THEN 'ratio' WHEN lift < {_T.governed_lift} THEN 'lift' ELSE '-' END
  WHEN 'reflexive_verb' THEN CASE WHEN n < {_T.count} THEN 'count' WHEN n / a < {_T.reflexive_share} THEN 'share' ELSE '-' END
  WHEN 'separable_verb' THEN CASE WHEN discontinuous = 0 THEN 'fused_only' WHEN n < {_T.count} THEN 'count' ELSE '-' END
  WHEN 'expression' THEN CASE WHEN n < {_T.carriers} THEN 'count' ELSE '-' END
  WHEN 'connector' THEN 'not_listed'
  ELSE CASE WHEN n < CASE kind WHEN 'noun_verb' THEN {_T.count} ELSE {_T.adjective_count} END THEN 'count' WHEN least(a, b) < {_T.pair_lemma} THEN 'lemma_count' WHEN NOT listed THEN 'not_a_noun'
    WHEN everyday < {_T.pair_everyday} THEN 'everyday' WHEN g2 < {_T.pair_g2} THEN 'g2' WHEN lift < CASE kind WHEN 'noun_verb' THEN {_T.pair_lift} ELSE {_T.adjective_lift} END THEN 'lift' ELSE '-' END END END AS reason FROM m)"""

ORACLES = {
    "unit_tally": f"{_TALLY} SELECT * FROM t",
    "unit_tally_merged": f"{_TALLY} SELECT * FROM t",
    "unit_decisions": f"{_DECIDED} SELECT kind, key, n, reason = '-' AS accept, reason, CASE WHEN len % 5 = 0 THEN 'mined+curated' ELSE 'mined' END AS origin FROM d",
    "decision_report": f"{_DECIDED} SELECT kind, reason, count(*) AS n FROM d GROUP BY ALL",
    "forced_words": f"{_DECIDED} SELECT DISTINCT unnest(string_split(key, ' ')) AS word FROM d WHERE reason = '-' AND kind IN ('noun_verb', 'adj_verb')",
}
