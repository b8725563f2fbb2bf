"""Levels, tiers, due days and false sources on hand-made rows."""

from pyspark.sql import functions as F

from lexspark.operators import families, levels, ngrams


def test_bands(spark):
    rows = spark.createDataFrame([(0, 1.0), (4_999, 7.0), (5_000, 21.0), (19_999, 89.9), (49_999, 90.0), (50_000, None), (None, None)], "rank int, s double")
    got = rows.select(levels.frequency_band(F.col("rank")).alias("b"), levels.stability_band(F.col("s")).alias("s")).collect()
    assert [r.b for r in got] == ["A1", "A1", "A2", "B1", "B2", "above", "above"]
    assert [r.s for r in got] == ["fresh", "young", "mature", "mature", "solid", None, None]


def test_tiers(spark):
    lines = spark.createDataFrame([("a", "Das Haus ist alt"), ("b", "Das Xyz"), ("c", "Abc def ghi"), ("d", "Donaudampfschiff Donaudampfschiff"), ("e", "..."), ("f", None)], "line_id string, text string")
    frequent = spark.createDataFrame([("das",), ("haus",), ("ist",), ("alt",), ("Donaudampfschiff",)], "word string")
    assert {r.line_id: r.tier for r in levels.difficulty_tiers(lines, frequent).collect()} == {"a": 1, "b": 2, "c": 3, "d": 3, "e": 1, "f": 1}
    assert {r.line_id: r.tier for r in levels.difficulty_tiers(lines, frequent.limit(0)).collect()} == {"a": 1, "b": 1, "c": 1, "d": 3, "e": 1, "f": 1}


def test_due_days(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-20 11:00:00'), (1, timestamp'2024-01-20 23:59:59'), (1, timestamp'2024-01-21 00:00:00'), (1, timestamp'2024-01-22 00:00:00'), (2, timestamp'2024-02-01 00:00:00') AS t(learner, due)")
    got = {r.learner: (r.now, r.today, r.tomorrow) for r in levels.due_counts(rows, F.lit("2024-01-20 12:00:00").cast("timestamp")).collect()}
    assert got == {1: (1, 2, 1), 2: (0, 0, 0)}


def test_false_sources(spark):
    store = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "p")], "german string, source string")
    texts = lambda *x: spark.createDataFrame([(t,) for t in x], "german string")
    assert {r.german for r in levels.contradictory(store, texts("a", "b", "c", "a"), texts("b"), "p").collect()} == {"a"}


def test_pairs_of_forms(spark):
    words = spark.createDataFrame([(w,) for w in ("hand", "hände", "kenntnis", "kenntnisse", "kenntnise", "schon", "schön", "schöne", "ab", "abe")], "word string")
    got = {(r.word, r.form) for r in families.inflected_pairs(words).collect() if r.word < r.form}
    assert got == {("hand", "hände"), ("kenntnis", "kenntnise"), ("kenntnis", "kenntnisse"), ("schon", "schöne"), ("schön", "schöne")}


def test_runs_are_cut_at_unknown_words(spark):
    lines = spark.createDataFrame([("x", "Ein altes Haus quer ein altes, Haus"), ("y", "ein Altes"), ("y", None)], "source string, text string")
    words = spark.createDataFrame([("ein",), ("altes",), ("haus",)], "word string")
    got = {r.ngram: (r.n, r.everyday) for r in ngrams.ngram_counts(lines, words, ["y"], 1).collect()}
    assert got == {"ein altes": (3, 1), "altes haus": (1, 0), "ein altes haus": (1, 0)}
    assert ngrams.ngram_counts(lines, words.limit(0), ["y"], 1).count() == 0
