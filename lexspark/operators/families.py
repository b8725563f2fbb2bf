"""Words of a corpus that are forms of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import forms as W
from lexspark.functions import text as X


def distinct_words(lines: DataFrame) -> DataFrame:
    """``(word, n)`` of all lower-case words of ``lines(text)``."""
    return lines.select(F.explode(X.letter_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def inflected_pairs(words: DataFrame) -> DataFrame:
    """``(word, form)``, both ways, of ``words(word)`` that are one word in two endings.

    Words meet by their stems, in an equi-join. A stem has as many words as there are endings and
    umlauts in it, so no key is hot. Stems only propose: ``forms.inflection`` decides.
    """
    doubled = F.regexp_extract("word", "^(.*nis)sen?$", 1)
    keys = F.array_distinct(F.concat(W.stems(F.col("word")), F.when(doubled != "", F.array(X.ascii_fold(doubled))).otherwise(F.array().cast("array<string>"))))
    each = words.select("word", F.explode(keys).alias("stem"))
    met = each.join(each.withColumnRenamed("word", "form"), "stem").where("word <> form").select("word", "form").distinct()
    return met.where(W.inflection(F.col("word"), F.col("form")))
