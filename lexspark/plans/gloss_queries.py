"""Queries over glosses: passes of a translation job, proposals and their refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import corpus
from lexspark.operators import gloss as G
from lexspark.plans.tables import read

GERMAN_ONLY = ["und", "nicht", "auf", "mit", "widget"]


def translation_passes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents by queue: those of the benchmark are in use, those of conversations are glossed."""
    carriers = corpus.sentences(read(spark, d, "documents")).groupBy("text").agg(F.min("line_id").alias("line_id"))
    used = read(spark, d, "benchmark").select(F.explode(X.sentences_of(F.col("text"))).alias("text")).distinct()
    store = carriers.select("text", F.when(F.crc32("text") % 7 == 0, "old").when(F.crc32("text") % 7 == 1, "azure").alias("source")).where("source is not null")
    held = G.passes(carriers, store, used, ["old"], X.plausible(F.col("text")))
    return held.groupBy("queue").agg(F.count("*").alias("n"), F.min("order_key").alias("first"))


def verb_glosses(spark: SparkSession, d: str) -> DataFrame:
    """Part names as equivalents of verbs in several wordings."""
    n = F.col("p_name")
    said = F.array(n, F.concat(F.lit("must "), n), F.concat(F.lit("to "), F.upper(n)), F.concat(F.lit("not to "), n), F.concat(F.lit(" has to "), n))
    return read(spark, d, "part").select("p_partkey", F.array_join(G.verb_glosses(said), "|").alias("glosses"))


def gloss_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Proposals for part names: their words, a longer one, and for some the name itself."""
    n = F.col("p_name")
    said = F.array(F.concat(F.lit("a "), F.element_at(F.split(n, " "), 1)), F.when(F.col("p_size") % 5 == 0, n).otherwise(F.concat(F.lit("the "), F.col("p_brand"))), F.when(F.col("p_size") % 7 == 0, F.repeat(n, 9)).otherwise(F.element_at(F.split(n, " "), 2)))
    held = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 11 != 0, said).otherwise(F.slice(said, 1, 0)).alias("said"), "p_name")
    return held.select("p_partkey", F.coalesce(G.gloss_reason(F.col("said"), F.col("p_name"), GERMAN_ONLY), F.lit("fine")).alias("reason"))


def context_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of conversations as contexts of the connector ``the``."""
    held = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.sentences_of(F.col("text"))).alias("pos", "text")).where("text <> ''")
    reason = G.context_reason(F.col("text"), F.when(F.col("turn") % 3 != 0, F.col("text")), F.lit("the"), X.plausible(F.col("text")))
    return held.groupBy(F.coalesce(reason, F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (translation_passes, verb_glosses, gloss_reasons, context_reasons)}

_SENTENCES = r"list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x))"

ORACLES = {
    "verb_glosses": """SELECT p_partkey, 'to ' || p_name || '|to have to ' || p_name || '|to not ' || p_name AS glosses FROM part""",
    "gloss_reasons": """WITH s AS (SELECT p_partkey, p_name, p_size, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'empty' WHEN w[1] = 'widget' THEN 'german_leak' WHEN p_size % 5 = 0 THEN 'german_echoed'
  WHEN p_size % 7 = 0 THEN CASE WHEN length(p_name) * 9 > 60 THEN 'too_long' ELSE 'german_leak' END WHEN w[2] = 'widget' THEN 'german_leak' ELSE 'fine' END AS reason FROM s""",
    "context_reasons": rf"""WITH s AS (SELECT conv_id, turn, unnest({_SENTENCES}) AS text FROM conversations), t AS (SELECT *, string_split_regex(text, '\s+') AS w FROM s WHERE text <> '')
SELECT CASE WHEN len(w) NOT BETWEEN 4 AND 14 THEN 'length' WHEN NOT regexp_matches(text, '[.!?]$') THEN 'no_terminal_punctuation' WHEN regexp_matches(text, '["„“\n]') THEN 'quotes_or_newline'
  WHEN list_contains(list_transform(w, lambda x: trim(lower(x), '.,!?')), 'the') THEN 'contains_connector' WHEN turn % 3 = 0 THEN 'empty_english'
  WHEN NOT (length(text) BETWEEN 25 AND 160 AND len(w) BETWEEN 5 AND 18 AND NOT regexp_matches(text, '[|<>\[\]{{}}\t]')) THEN 'carrier_rejected' ELSE 'fine' END AS reason, count(*) AS n FROM t GROUP BY 1""",
}
