"""Chunks of conversations for batch jobs, and marks of neighbouring words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import chunks, letters
from lexspark.plans.tables import lines, read

MOST, COUNT = 4_000, 12


def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations in chunks of a size and a count, as batch jobs take them: rows, bytes and first turn of each chunk."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    held = chunks.chunked(turns, F.col("bytes"), [F.col("conv_id"), F.col("turn")], MOST, COUNT, block=4_096)
    first = F.min(F.struct("conv_id", "turn"))
    told = held.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), first.alias("first"))
    return told.select("chunk", "n", "bytes", F.col("first.conv_id").alias("conv_id"), F.col("first.turn").alias("turn"))


def neighbour_marks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of words that follow each other in a line, as if one were typed for the other: distance, closeness and marks."""
    words = lines(spark, d).select(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w")).where("size(w) > 1")
    pairs = words.select(F.inline(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("typed"), F.expr("slice(w, 2, size(w) - 1)").alias("expected")))).distinct()
    told = letters.letter_marks(pairs)
    return told.select("typed", "expected", "distance", "close", F.array_join(F.transform("marks", lambda m: F.concat_ws(":", m["op"], m["typed"], m["expected"])), " ").alias("marks"))


QUERIES = {f.__name__: f for f in (batch_chunks, neighbour_marks)}
ORACLES = {
    "batch_chunks": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations),
c(i, chunk, held, n) AS (SELECT i, 0::BIGINT, bytes, 1::BIGINT FROM t WHERE i = 1
  UNION ALL SELECT t.i, CASE WHEN c.held + t.bytes > {MOST} OR c.n >= {COUNT} THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.held + t.bytes > {MOST} OR c.n >= {COUNT} THEN t.bytes ELSE c.held + t.bytes END, CASE WHEN c.held + t.bytes > {MOST} OR c.n >= {COUNT} THEN 1 ELSE c.n + 1 END
  FROM c JOIN t ON t.i = c.i + 1)
SELECT chunk, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(conv_id, i) AS conv_id, arg_min(turn, i) AS turn FROM c JOIN t USING (i) GROUP BY chunk""",
}
