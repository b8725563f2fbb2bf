"""n-grams of a corpus and the expressions among them: counts, weakest seam, growth, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import statistics as S
from lexspark.functions import text as X
from lexspark.storage import stored

SIZES = (2, 3, 4)


def vocabulary(lines: DataFrame, size: int = 20_000) -> DataFrame:
    """``(word, n)``: the commonest words, ties in the order of the alphabet. ``size`` bounds it."""
    words = lines.select(F.explode(X.letter_tokens(F.col("text"))).alias("word")).select(X.normalise(F.col("word")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def _grams(words: Column) -> Column:
    """All runs of 2 to 4 words without a null among them, space-joined."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        joined = lambda i: F.concat(F.get(words, i), *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))])
        return F.transform(starts, joined)

    return F.filter(F.concat(*[F.when(F.size(words) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in SIZES]), lambda g: g.isNotNull())


def ngram_counts(lines: DataFrame, words: DataFrame, everyday: list[str], floor: int = 30) -> DataFrame:
    """``(ngram, n, everyday)`` of at least ``floor`` occurrences, all of whose words are in ``words``.

    A run ends at anything but one space. ``words`` is a vocabulary of bounded size (see ``vocabulary``):
    runs are cut at words outside it before anything is shuffled, so only n-grams of known words are counted.
    """
    known = ",".join("'" + r.word.replace("\\", "\\\\").replace("'", "\\'") + "'" for r in words.select("word").distinct().collect())
    runs = lines.select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.RUN), F.lit(0))).alias("run"))
    split = runs.select("source", F.split(X.normalise(F.col("run")), " ").alias("words")).where(F.size("words") >= min(SIZES))
    cut = F.expr(f"transform(words, w -> if(w in ({known or 'null'}), w, null))")  # one text: a literal each would take a call each
    marked = split.select("source", cut.alias("words"))
    grams = marked.select("source", F.explode(_grams(F.col("words"))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").alias("n"), F.count_if(F.col("source").isin(everyday)).alias("everyday")).where(F.col("n") >= floor)


def min_split_pmi(ngrams: DataFrame, words: DataFrame, sentences: int | Column) -> DataFrame:
    """``ngrams`` with ``score``: the least PMI over the cuts in two, 0 if a half was not counted."""
    total = F.lit(sentences) if isinstance(sentences, int) else sentences
    halves = ngrams.select(F.col("ngram").alias("part"), F.col("n").alias("part_n")).union(words.select("word", "n"))
    tokens = F.split("ngram", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size(tokens) - 1))
    cuts = ngrams.withColumn("cut", cut).withColumn("left", F.array_join(F.slice(tokens, F.lit(1), F.col("cut")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice(tokens, F.col("cut") + 1, F.size(tokens)), " "))
    a = halves.select(F.col("part").alias("left"), F.col("part_n").alias("left_n"))
    b = halves.select(F.col("part").alias("right"), F.col("part_n").alias("right_n"))
    held = cuts.join(a, "left", "left").join(b, "right", "left")
    seam = F.min(S.pmi(F.col("n"), F.col("left_n"), F.col("right_n"), total))
    missing = F.max(F.col("left_n").isNull() | F.col("right_n").isNull())
    scored = held.groupBy("ngram", "n", "everyday").agg(seam.alias("seam"), missing.alias("missing"))
    return scored.select("ngram", "n", "everyday", F.when(F.col("missing"), F.lit(0.0)).otherwise(F.col("seam")).alias("score"))


def carries_vocabulary(ngram: Column, function_words: list[str]) -> Column:
    """A pair of two content words, or a longer one with one at least."""
    tokens = F.split(ngram, " ")
    content = F.size(F.filter(tokens, lambda w: ~w.isin(function_words)))
    return F.when(F.size(tokens) == 2, content == 2).otherwise(content >= 1)


def grown(candidates: DataFrame, ngrams: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Candidates grown, word by word, to the longest n-gram that has ``ratio`` of their count.

    n-grams have four words at most, so two steps are all there are. The commonest extension wins,
    ties go by text; of candidates that grow into one text the best scored stays.
    """
    t = F.split("ngram", " ")
    ends = F.array(F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), " "), F.array_join(F.slice(t, F.lit(2), F.size(t) - 1), " "))
    longer = ngrams.where(F.size(t) > 2).select(F.explode(F.array_distinct(ends)).alias("text"), F.col("ngram").alias("longer"), F.col("n").alias("longer_n"))
    best = longer.groupBy("text").agg(F.max(F.struct("longer_n")).alias("m"), F.min(F.struct((-F.col("longer_n")).alias("k"), "longer", "longer_n")).alias("best")).select("text", "best.longer", "best.longer_n")
    now = candidates.select(F.col("ngram").alias("text"), "n", "score")
    for _ in range(max(SIZES) - min(SIZES)):
        step = now.join(best, "text", "left")
        grows = F.coalesce(F.col("longer_n") >= ratio * F.col("n"), F.lit(False))
        now = step.select(F.when(grows, F.col("longer")).otherwise(F.col("text")).alias("text"), F.when(grows, F.col("longer_n")).otherwise(F.col("n")).alias("n"), "score")
    return now.groupBy("text", "n").agg(F.max("score").alias("score"))


def contained(candidates: DataFrame, slack: float = 1.25) -> DataFrame:
    """``(text, container, dist)`` of candidates that are part of another one ranked before them with a close count.

    Rank is score, count, text. Parts are found by an equi-join on all substrings of a candidate.
    """
    n = F.length("text")
    starts = F.sequence(F.lit(1), n)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col("text"), i, k))))
    a = candidates.select(F.col("text").alias("container"), F.col("n").alias("container_n"), F.col("score").alias("container_score"), F.explode(F.array_distinct(parts)).alias("text"))
    hit = a.join(candidates, "text").where("text <> container").where(F.col("n") <= slack * F.col("container_n"))
    before = (F.col("container_score") > F.col("score")) | ((F.col("container_score") == F.col("score")) & ((F.col("container_n") > F.col("n")) | ((F.col("container_n") == F.col("n")) & (F.col("container") < F.col("text")))))
    return hit.where(before).select("text", "container")


def without_contained(candidates: DataFrame, slack: float = 1.25) -> DataFrame:
    """Candidates that are not part of a kept one ranked before them.

    A candidate is dropped by a kept container only, so the rule is settled by rounds: kept are those
    all of whose containers are dropped. Containers are longer than their parts, so rounds are as
    many as the longest chain of texts inside each other; what is left of the links gets less each time.
    """
    links = stored(contained(candidates, slack))
    dropped = None
    while not links.isEmpty():
        open_ = links.select(F.col("text").alias("container")).distinct()
        sure = stored(links.join(open_, "container", "left_anti").select("text").distinct())  # their container has none itself: it is kept
        dropped = sure if dropped is None else dropped.union(sure)
        gone = sure.withColumnRenamed("text", "container")
        links = stored(links.join(sure, "text", "left_anti").join(gone, "container", "left_anti"))
    return candidates if dropped is None else candidates.join(dropped, "text", "left_anti")
