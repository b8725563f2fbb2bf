"""Exact length histogram: documents by encoded length, and what suffix sums over it answer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.common import checkpoint, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokeniser pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in one block of the two-level suffix sums.
BLOCK = 4_096


@functools.cache
def encoding(path: str):
    """The tokenizer of a file of ``base64 rank`` lines, once a Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(n_tokens)`` of every row, special tokens' strings counted as ordinary text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py() or "")) for t in b.column(0)], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(n_tokens, n_docs)``, one row for each length that occurs."""
    return token_counts(docs, text_col, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_table(histogram: DataFrame) -> DataFrame:
    """The histogram with sums that answer every context limit at once.

    For each length L: ``docs_from``, ``tokens_from`` (documents of at least L tokens and their
    tokens), ``total_docs``, ``total_tokens``, ``truncated_tokens`` (all tokens left if every
    document is cut at L), ``docs_over`` (documents that L cuts) and ``share_to`` (documents of at most
    L tokens over all: the first row with ``share_to`` >= q is the q-quantile). A limit between two
    lengths M < L gives truncated(M) + (limit - M) * docs_over(M).

    The sums go in two levels, inside blocks of lengths and over the blocks, so that no task holds
    all lengths. No rows: no rows.
    """
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"), F.sum("d").over(whole).alias("total_docs"), F.sum("t").over(whole).alias("total_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.join(blocks, "block").withColumn("docs_from", F.sum("n_docs").over(own) + F.col("d_after"))
    h = h.withColumn("tokens_from", F.sum(F.col("n_docs") * F.col("n_tokens")).over(own) + F.col("t_after"))
    over = F.col("docs_from") - F.col("n_docs")
    return h.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        over.alias("docs_over"), ((F.col("total_docs") - over) / F.col("total_docs")).alias("share_to"),
    )


def quantile(lengths: DataFrame, q: float) -> DataFrame:
    """``(n_tokens)``: the smallest length that at least ``q`` of the documents do not exceed. No rows for no documents."""
    return lengths.where(F.col("share_to") >= q).agg(F.min("n_tokens").alias("n_tokens")).where("n_tokens is not null")


def truncated_total(lengths: DataFrame, limit: int) -> DataFrame:
    """``(tokens)``: tokens that are left if each document is cut at ``limit``."""
    cut = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return lengths.agg(F.coalesce(F.sum(cut), F.lit(0)).cast("long").alias("tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(checkpoint(length_histogram(table(spark, sf_dir, "documents"))))
