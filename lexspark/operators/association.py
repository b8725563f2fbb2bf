"""Pairs in sentences and how they go together; frequencies per million over weighted corpora; modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import statistics as S
from lexspark.functions import text as X
from lexspark.storage import stored


def word_sentences(lines: DataFrame) -> DataFrame:
    """``(source, word, n)``: sentences of a corpus that have the word, each counted once."""
    words = lines.select("source", F.explode(F.array_distinct(X.letter_tokens(F.col("text")))).alias("word"))
    return words.groupBy("source", "word").agg(F.count("*").alias("n"))


def pair_association(lines: DataFrame, floor: int = 5) -> DataFrame:
    """``(a, b, pair, n_a, n_b, total, g2, lift)`` of neighbouring words, counted in sentences.

    A pair counts once a sentence, and so do its words. Pairs below ``floor`` go before the two
    lookups of marginals. Words are stored, since pairs, single words and the total all need them.
    """
    each = stored(lines.select(X.letter_tokens(F.col("text")).alias("t")))
    total = each.agg(F.count("*").alias("total"))
    single = each.select(F.explode(F.array_distinct("t")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    neighbours = F.array_distinct(F.transform(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda w, i: F.struct(w.alias("a"), F.get(F.col("t"), i + 1).alias("b"))))
    pairs = each.select(F.explode(neighbours).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("pair")).where(F.col("pair") >= floor)
    held = pairs.join(single.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
    held = held.crossJoin(F.broadcast(total))  # one row
    args = [F.col(c) for c in ("pair", "n_a", "n_b", "total")]
    return held.select("a", "b", "pair", "n_a", "n_b", "total", S.log_likelihood(*args).alias("g2"), S.lift(*args).alias("lift"))


def per_million(counts: DataFrame, totals: DataFrame, weight: Column) -> DataFrame:
    """``(word, per_million)``: the mean over corpora of occurrences in a million sentences, corpora weighted.

    ``counts(source, word, n)``, ``totals(source, sentences)``; a corpus without the word counts as 0
    of it, one without sentences not at all.
    """
    sized = totals.where("sentences > 0").withColumn("w", weight)
    whole = sized.agg(F.sum("w").alias("weights"))
    held = counts.join(F.broadcast(sized), "source").groupBy("word").agg(F.sum(F.col("w") * 1e6 * F.col("n") / F.col("sentences")).alias("x"))
    return held.crossJoin(F.broadcast(whole)).select("word", (F.col("x") / F.col("weights")).alias("per_million"))


def register_spread(counts: DataFrame, totals: DataFrame, everyday: list[str]) -> DataFrame:
    """``(ngram, source, n)``: counts of two registers, spread over the corpora of each by their sizes, half to even."""
    t = totals.where("sentences > 0").withColumn("everyday_source", F.col("source").isin(everyday))
    t = t.join(t.groupBy("everyday_source").agg(F.sum("sentences").alias("register")), "everyday_source")
    own = F.least("everyday", "n")
    amount = F.when(F.col("everyday_source"), own).otherwise(F.col("n") - own)
    held = counts.select("ngram", "n", "everyday").crossJoin(F.broadcast(t))  # corpora: a few rows
    return held.where(amount > 0).select("ngram", "source", F.bround(amount * F.col("sentences") / F.col("register")).cast("long").alias("n"))


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The commonest value of a group, of equals the one seen first, with its count and share."""
    per = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(F.col(value).alias("mode"), "n"), F.struct(F.col("n"), (-F.col("first")).alias("f")))
    held = per.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("total"))
    return held.select(*keys, "b.mode", "b.n", F.round(F.col("b.n") / F.col("total"), 6).alias("share"))


def majority(rows: DataFrame, keys: list[str], value: str, order: Column, share: float) -> DataFrame:
    """As ``first_seen_mode``, but null where the mode's share is below ``share``."""
    held = first_seen_mode(rows, keys, value, order)
    return held.withColumn("mode", F.when(F.col("share") >= share, F.col("mode")))


def settled_variants(stats: DataFrame, share: float = 0.6) -> DataFrame:
    """``stats(pair, variant, n, ord)`` with one winner a pair; ``variant`` is null for the bare pair.

    The commonest variant wins if it has ``share`` of the pair's total (of equals the first seen),
    else the bare pair does. The winner takes all counts.
    """
    group = Window.partitionBy("pair")
    best = F.max_by(F.col("variant"), F.when(F.col("variant").isNotNull(), F.struct(F.col("n"), (-F.col("ord")).alias("o")))).over(group)
    most = F.max(F.when(F.col("variant").isNotNull(), F.col("n"))).over(group)
    held = stats.withColumn("best", best).withColumn("most", most).withColumn("total", F.sum("n").over(group))
    winner = F.when(F.col("most") / F.col("total") >= share, F.col("best"))
    return held.withColumn("winner", winner).groupBy("pair", "winner").agg(F.sum("n").alias("n"), F.count("*").alias("merged"))
