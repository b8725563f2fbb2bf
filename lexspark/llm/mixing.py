"""Mixing sources to target weights: tokens per source, repetition rates, whole copies plus one drawn copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.common import checkpoint, n_words, seeded_unit, set_aside, table

#: Beyond so many sources the table of rates is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def source_rates(sized: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """``(source, source_size, target, rate)`` of ``sized(source, size)``.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all
    sizes by weight. No target is above ``most`` times its source's size; what is cut is shared
    again by weight. That ends at target = least(cap, level * weight) with one level for all
    sources, which is found in the sources' order of cap / weight: the first source that stays
    under its cap if all before it are capped gives the level. Sources of size 0 get target and rate 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - before) / left
    per = per.withColumn("level", level).withColumn("at", F.row_number().over(order))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(whole)
    per = per.withColumn("target", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def with_copies(docs: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0, seed: int = 20) -> DataFrame:
    """Columns of ``docs(doc_id, source, text)`` and ``size, source_size, target, copies``.

    ``copies`` is floor(rate), and one more if a number drawn from the seed and the doc_id is below
    the fraction of the rate; it never is above ``most`` for whole ``most``. The rates are a small
    table, counted before it is broadcast. Rows with the same doc_id draw alike. A null text has
    size 0; a null source is a source of its own. Columns of ``docs`` with the names of new columns
    are replaced, all others stay. No rows: no rows.
    """
    docs, back = set_aside(docs, ("_source", "rate"))
    docs = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words(F.col("text")))
    rates = checkpoint(source_rates(docs.select("source", "size"), share, weights, most)).withColumnRenamed("source", "_source")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    held = docs.join(rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    extra = seeded_unit(seed, F.col("doc_id")) < F.col("rate") - whole
    return held.withColumn("copies", (whole + extra.cast("int")).cast("int")).drop("rate").withColumnsRenamed(back)


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as ``with_copies`` says, the columns of ``docs``, whatever their names."""
    docs, back = set_aside(docs, ("size", "source_size", "target", "copies", "_copy"))
    taken = with_copies(docs, **options).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(docs.columns).withColumnsRenamed(back)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY source
), caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)
             - coalesce(sum(cap) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
), target AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT min_by(level, ratio) FROM levels WHERE level <= ratio) * w, cap)) AS target FROM levels
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(d.size * (floor(t.target / greatest(t.source_size, 1))
         + CAST(CAST(('0x' || substr(md5('20:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE
                < t.target / greatest(t.source_size, 1) - floor(t.target / greatest(t.source_size, 1)) AS INTEGER)) AS BIGINT) AS taken
FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
"""
