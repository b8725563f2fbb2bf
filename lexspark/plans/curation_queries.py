"""Queries on hand-made lists. Units are parts, lists and cards are suppliers, orders and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import curation as C
from lexspark.plans.tables import LOG, log, read


def _units(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_name").alias("key"), F.lower(F.element_at(F.split("p_type", " "), 1)).alias("kind"), F.col("p_brand").alias("display"), F.col("p_size").cast("long").alias("rank"))


def _overrides(spark: SparkSession, d: str, side: int) -> DataFrame:
    """By name: the largest brand among parts of one half of the sizes; those of even length are for one kind only."""
    held = read(spark, d, "part").where(F.col("p_size") % 2 == side).groupBy(F.col("p_name").alias("key")).agg(F.max("p_brand").alias("display"))
    return held.select("key", F.when(F.length("key") % 2 == 0, "economy").alias("only_kind"), F.when(F.length("key") % 3 != side, F.col("display")).alias("display"))


def merged_overrides(spark: SparkSession, d: str) -> DataFrame:
    return C.merged_overrides(_overrides(spark, d, 0), _overrides(spark, d, 1), ["only_kind", "display"])


def overridden_parts(spark: SparkSession, d: str) -> DataFrame:
    return C.overridden(_units(spark, d), _overrides(spark, d, 0), ["display"]).select("unit", "kind", "display")


def requested_parts(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("key"), F.lower(F.element_at(F.split("p_type", " "), 1)).alias("kind"))
    return C.with_requests(_units(spark, d), asked).select("unit", "requested_order")


def deck_with_added(spark: SparkSession, d: str) -> DataFrame:
    deck = _units(spark, d).where("rank <= 25").select("unit", F.lit("deck").alias("origin"))
    added = read(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_partkey").alias("unit")).distinct().select("unit", F.lit("learner").alias("origin"))
    return C.with_added(deck, added)


def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").select(F.col("p_name").alias("key"), F.col("p_brand").alias("entry"), "p_size")
    return C.later_file_wins([names.where("p_size <= 20").drop("p_size"), names.where("p_size > 20 and p_size <= 30").drop("p_size"), names.where("p_size > 40").drop("p_size")], "key")


def wanted_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("text"))
    return C.wanted_lines(docs.where("id % 3 = 0"), docs.where("id % 3 = 1").groupBy("text").agg(F.min("id").alias("id")).select("id", "text"))


def contradictory_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem")
    found = C.contradictory(lines, lines.where("l_returnflag = 'R'"), lines.where("l_discount = 0"), ["l_partkey", "l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def folded_names(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n"))
    forms = read(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("form"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("key"))
    return C.folded_counts(counts, forms)


def governed_parts(spark: SparkSession, d: str) -> DataFrame:
    return C.governed(_units(spark, d).select(F.col("key").alias("verb"), F.col("kind").alias("prep"))).select("verb", F.array_join("preps", ",").alias("preps"))


def reserve_ranks(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(F.count("*").alias("n"))
    units = _units(spark, d)
    return C.reserve_ranks(counts.join(units.where("rank > 25"), "unit", "left_semi"), units.where("rank <= 25")).select("unit", "rank")


def first_requests(spark: SparkSession, d: str) -> DataFrame:
    return C.first_requests(log(spark, d).where("unit is not null"))


def showable_lines(spark: SparkSession, d: str) -> DataFrame:
    cards = read(spark, d, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("card"), F.col("l_partkey").alias("unit"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("gloss"),
        (F.col("l_discount") > 0.02).alias("needs_context"), F.when(F.col("l_tax") > 0.06, F.col("l_linestatus")).alias("context"),
    )
    return C.showable_cards(cards).select("card", "unit")


def unread_batches(spark: SparkSession, d: str) -> DataFrame:
    cards = read(spark, d, "part").select(F.col("p_partkey").alias("card"), F.col("p_size").alias("rank"))
    return C.unread_batches(cards, read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("card")), 30).select("card", "batch")


def batch_findings(spark: SparkSession, d: str) -> DataFrame:
    findings = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("card"), F.col("l_returnflag").alias("category"))
    batch = read(spark, d, "part").where("p_size between 10 and 20").select(F.col("p_partkey").alias("card"))
    return C.findings_of_batch(findings, batch, ["R", "A"]).select("l_orderkey", "l_linenumber", "category")


def fallback_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of order keys as frequency ranks."""
    return read(spark, d, "orders").groupBy(C.fallback_band(F.col("o_orderkey") * 10).alias("band")).agg(F.count("*").alias("n"))


def quota_days(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return read(spark, d, "events").groupBy(C.quota_month(ts).alias("month"), C.next_quota_midnight(ts).cast("timestamp_ntz").alias("until")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    merged_overrides, overridden_parts, requested_parts, deck_with_added, dictionary_entries, wanted_lines, contradictory_lines, folded_names, governed_parts,
    reserve_ranks, first_requests, showable_lines, unread_batches, batch_findings, fallback_bands, quota_days,
)}

_UNITS = "WITH units AS (SELECT p_partkey AS unit, p_name AS key, lower(string_split(p_type, ' ')[1]) AS kind, p_brand AS display, p_size AS rank FROM part)"
_OVER = "SELECT key, CASE WHEN length(key) % 2 = 0 THEN 'economy' END AS only_kind, CASE WHEN length(key) % 3 <> {0} THEN display END AS display FROM (SELECT p_name AS key, max(p_brand) AS display FROM part WHERE p_size % 2 = {0} GROUP BY p_name)"

ORACLES = {
    "merged_overrides": f"SELECT key, coalesce(b.only_kind, a.only_kind) AS only_kind, coalesce(b.display, a.display) AS display FROM ({_OVER.format(0)}) a FULL JOIN ({_OVER.format(1)}) b USING (key)",
    "overridden_parts": f"{_UNITS}, o AS ({_OVER.format(0)}) SELECT u.unit, u.kind, coalesce(o.display, u.display) AS display FROM units u LEFT JOIN o ON o.key = u.key AND (o.only_kind IS NULL OR o.only_kind = u.kind)",
    "requested_parts": f"{_UNITS} SELECT u.unit, (SELECT min(a.unit) FROM units a WHERE a.rank < 10 AND a.key = u.key AND a.kind = u.kind) AS requested_order FROM units u",
    "deck_with_added": f"{_UNITS} SELECT unit, 'deck' AS origin FROM units WHERE rank <= 25 UNION ALL SELECT DISTINCT l_partkey, 'learner' FROM lineitem WHERE l_quantity >= 40 AND l_partkey NOT IN (SELECT unit FROM units WHERE rank <= 25)",
    "dictionary_entries": """SELECT p_name AS key, CASE WHEN count(*) FILTER (p_size > 40) > 0 THEN min(p_brand) FILTER (p_size > 40) WHEN count(*) FILTER (p_size > 20 AND p_size <= 30) > 0 THEN min(p_brand) FILTER (p_size > 20 AND p_size <= 30)
      ELSE min(p_brand) FILTER (p_size <= 20) END AS entry FROM part WHERE p_size <= 30 OR p_size > 40 GROUP BY p_name""",
    "wanted_lines": """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, string_split(text, chr(10))[1] AS text FROM documents), have AS (SELECT * FROM l WHERE doc_id % 3 = 0)
      SELECT id, text FROM have UNION ALL SELECT min(id), text FROM l WHERE doc_id % 3 = 1 AND text NOT IN (SELECT text FROM have WHERE text IS NOT NULL) GROUP BY text""",
    "contradictory_lines": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey)
      AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_discount = 0 AND x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey)""",
    "folded_names": "SELECT l_partkey - l_partkey % 3 AS key, count(*) AS n FROM lineitem GROUP BY 1",
    "governed_parts": f"{_UNITS} SELECT key AS verb, array_to_string(list_sort(list_distinct(list(kind))), ',') AS preps FROM units GROUP BY key",
    "reserve_ranks": f"""{_UNITS}, c AS (SELECT l_partkey AS unit, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT unit FROM units WHERE rank > 25) GROUP BY 1)
      SELECT unit, row_number() OVER (ORDER BY n DESC, unit) + (SELECT max(rank) FROM units WHERE rank <= 25) AS rank FROM c""",
    "first_requests": f"WITH {LOG} SELECT learner, unit, CAST(row_number() OVER (PARTITION BY learner ORDER BY ts, seq) AS INTEGER) AS place FROM (SELECT learner, unit, ts, seq FROM log WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY learner, unit ORDER BY ts, seq) = 1)",
    "showable_lines": """WITH c AS (SELECT l_orderkey || '.' || l_linenumber AS card, l_partkey AS unit, l_discount <= 0.02 OR l_tax > 0.06 AS fit FROM lineitem WHERE l_returnflag <> 'A')
      SELECT card, unit FROM c QUALIFY fit OR NOT bool_or(fit) OVER (PARTITION BY unit)""",
    "unread_batches": "SELECT p_partkey AS card, CAST((row_number() OVER (ORDER BY p_size, p_partkey) - 1) // 30 + 1 AS BIGINT) AS batch FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "batch_findings": "SELECT l_orderkey, l_linenumber, l_returnflag AS category FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20)",
    "fallback_bands": "SELECT CASE WHEN o_orderkey <= 500 THEN 'A1' WHEN o_orderkey <= 1000 THEN 'A2' WHEN o_orderkey <= 2000 THEN 'B1' WHEN o_orderkey <= 5000 THEN 'B2' ELSE 'C' END AS band, count(*) AS n FROM orders GROUP BY 1",
    "quota_days": """SELECT strftime(ts - INTERVAL 8 HOUR, '%Y-%m') AS month, CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) + 1 AS TIMESTAMP) + INTERVAL 8 HOUR AS until, count(*) AS n FROM events GROUP BY 1, 2""",
}
