"""Decisions, glosses and patterns on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import gloss, patterns, units

STATS = "kind string, key string, n long, everyday long, discontinuous long, reflexive long, n_a long, n_b long, total long, listed boolean, seeded boolean, requested boolean, excluded boolean"


@pytest.mark.parametrize(
    ("kind", "change", "reason"),
    [
        ("verb_prep", {"reflexive": 60}, "mostly_reflexive"), ("verb_prep", {"n": 4}, "count"), ("verb_prep", {"n_a": 100_000}, "ratio"), ("verb_prep", {}, None),
        ("separable_verb", {"discontinuous": 0}, "fused_only"), ("noun_verb", {"listed": False}, "not_a_noun"), ("noun_verb", {"everyday": 2}, "everyday"), ("noun_verb", {"n_b": 19}, "lemma_count"),
        ("adj_noun", {"n": 39}, "count"), ("connector", {}, "not_listed"), ("connector", {"seeded": True}, None), ("noun", {"n": 99}, "count"),
        ("noun", {"n": 1, "requested": True}, None), ("noun", {"requested": True, "excluded": True}, "excluded"),
    ],
)
def test_decision(spark, kind, change, reason):
    row = {"kind": kind, "key": "a b", "n": 100, "everyday": 50, "discontinuous": 5, "reflexive": 0, "n_a": 300, "n_b": 200, "total": 100_000, "listed": True, "seeded": False, "requested": False, "excluded": False}
    got = units.decided(spark.createDataFrame([{**row, **change}], STATS)).first()
    assert (got.reason, got.accept) == (reason, reason is None)


def test_unseen_curated_units_and_trivial_words(spark):
    stats = spark.createDataFrame([("noun", "a", 3, 0, 0, 0, 0, 9)], "kind string, key string, n long, everyday long, discontinuous long, reflexive long, initial long, first long")
    rows = units.with_unseen(stats, spark.createDataFrame([("noun", "a"), ("idiom", "b")], "kind string, key string")).collect()
    assert {(r.key, r.n) for r in rows} == {("a", 3), ("b", 0)}
    ranked = spark.createDataFrame([("noun", "x", 5, False), ("noun", "y", 5, True), ("idiom", "z", 1, False), ("noun", "s", 900, False)], "kind string, key string, rank long, requested boolean")
    got = units.trivial(ranked, spark.createDataFrame([("s",)], "word string")).collect()
    assert {r.key: r.trivial_reason for r in got} == {"x": "rank", "y": None, "z": None, "s": "stoplist"}


def test_pattern_with_gaps_and_longest(spark):
    lines = spark.createDataFrame([("1", "Das kommt mir gar nicht in Frage."), ("2", "Es kommt nicht in Frage."), ("3", "In Frage kommt es.")], "line_id string, text string")
    held = spark.createDataFrame([("k", ["kommt", "in", "frage"], 3, None), ("f", ["in", "frage"], 0, None), ("n", ["kommt", "frage"], 1, None), ("u", ["in", "frage"], 0, ["mir"])], "key string, words array<string>, max_gap int, unless array<string>")
    hits = patterns.pattern_hits(lines, held)
    assert {(r.key, r.line_id): list(r.places) for r in hits.collect()} == {("k", "1"): [1, 5, 6], ("k", "2"): [1, 3, 4], ("f", "1"): [5, 6], ("f", "2"): [3, 4], ("f", "3"): [0, 1], ("u", "2"): [3, 4], ("u", "3"): [0, 1]}
    assert {(r.key, r.line_id) for r in patterns.longest_hits(hits).collect()} == {("k", "1"), ("k", "2"), ("f", "3"), ("u", "3")}


def test_glosses(spark):
    row = spark.range(1).select(
        gloss.verb_glosses(F.array(*[F.lit(x) for x in ("must go", "has to go", "to wait", "not to be", "enjoy")])).alias("v"),
        gloss.gloss_reason(F.array(F.lit("house")), F.lit("Haus"), ["und"]).alias("ok"), gloss.gloss_reason(F.array(F.lit("this und that")), F.lit("x"), ["und"]).alias("leak"),
        gloss.written_reason(F.lit("Das Haus ist alt."), F.lit("The house is old."), F.lit("Haus"), F.lit("Hund"), F.lit(True)).alias("w"),
        gloss.written_reason(F.lit("Das Haus ist alt."), F.lit("The house is old."), F.lit("Dach"), F.lit("Dach"), F.lit(True)).alias("s"),
    ).first()
    assert row.v == ["to have to go", "to wait", "to not be", "to enjoy"] and (row.ok, row.leak, row.w, row.s) == (None, "german_leak", None, "surface_not_in_sentence")
