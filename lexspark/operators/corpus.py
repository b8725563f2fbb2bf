"""Corpora: documents to sentences, the plausible ones, one owner for each sentence, and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X


def sentences(docs: DataFrame) -> DataFrame:
    """``(source, line_id, ord, text)`` of documents; ``ord`` is doc_id and place, so any order can be made total."""
    each = docs.select("doc_id", "source", F.posexplode(X.sentences_of(F.col("text"))).alias("pos", "text")).where("text <> ''")
    return each.select("source", F.concat_ws("#", F.col("doc_id"), F.col("pos")).alias("line_id"), "doc_id", "pos", "text")


def plausible_sentences(docs: DataFrame) -> DataFrame:
    return sentences(docs).where(X.plausible(F.col("text")))


def owned(lines: DataFrame, priority: Column) -> DataFrame:
    """One row for each text, that of the corpus that comes first; ties go by doc_id and place.

    The least of a struct is a partial aggregate, so a sentence that is everywhere is one row a task.
    """
    first = F.min(F.struct(priority.alias("p"), "doc_id", "pos", "source", "line_id")).alias("o")
    return lines.groupBy("text").agg(first, F.count("*").alias("copies")).select("o.source", "o.line_id", "o.doc_id", "o.pos", "text", "copies")


def seeded_sample(lines: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` lines in an order that depends on the seed and the text only."""
    return lines.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("text")), 256), "line_id").limit(n)
