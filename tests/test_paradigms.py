"""Paradigms: cells of German forms, rules of weak verbs, shapes and plurals."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import paradigms as P


def column(spark, words, expression):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, word string")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_closed_classes():
    rows = P.closed_rows()
    assert len(rows) == len(set(rows))
    held = {}
    for family, _, form, case, gender, number, person in rows:
        held.setdefault((family, form), set()).add((case, gender, number, person))
    assert held["definite", "dem"] == {("Dat", "Masc", "Sing", None), ("Dat", "Neut", "Sing", None)}
    assert len(held["definite", "der"]) == 6 and len(held["definite", "die"]) == 8 and len(held["definite", "den"]) == 4
    assert held["ein", "mein"] == {("Nom", "Masc", "Sing", None), ("Nom", "Neut", "Sing", None), ("Acc", "Neut", "Sing", None)}
    assert held["relative", "denen"] == {("Dat", "Unk", "Plur", None)} and held["relative", "dessen"] == {("Gen", "Masc", "Sing", None), ("Gen", "Neut", "Sing", None)}
    assert held["personal", "sie"] == {("Nom", "Fem", "Sing", "3"), ("Acc", "Fem", "Sing", "3"), ("Nom", "Unk", "Plur", "3"), ("Acc", "Unk", "Plur", "3")}
    assert held["reflexive", "sich"] == {(c, "Unk", n, "3") for c in ("Acc", "Dat") for n in ("Sing", "Plur")}


def test_adjectives_are_declined(spark):
    got = {(r.declension, r.case, r.gender, r.number): r.form for r in P.declined(spark.createDataFrame([("stark",), ("stark",), (None,)], "lemma string")).collect()}
    assert len(got) == 72
    assert got["strong", "Dat", "Masc", "Sing"] == "starkem" and got["mixed", "Nom", "Neut", "Sing"] == "starkes" and got["weak", "Acc", "Fem", "Sing"] == "starke" and got["strong", "Gen", "Neut", "Plur"] == "starker"


def test_weak_verbs_are_conjugated(spark):
    got = {}
    for r in P.conjugated(spark.createDataFrame([(w,) for w in ("machen", "arbeiten", "tanzen", "wandern", "ab", "reden", None)], "lemma string")).collect():
        got.setdefault((r.lemma, r.tense), {})[r.person + r.number[0]] = r.form
    assert got["machen", "Pres"] == {"1S": "mache", "2S": "machst", "3S": "macht", "1P": "machen", "2P": "macht", "3P": "machen"}
    assert got["arbeiten", "Pres"]["2S"] == "arbeitest" and got["arbeiten", "Pres"]["3S"] == "arbeitet" and got["arbeiten", "Past"]["2P"] == "arbeitetet"
    assert got["tanzen", "Pres"]["2S"] == "tanzt" and got["wandern", "Past"]["1S"] == "wanderte" and got["reden", "Past"]["3P"] == "redeten"
    assert len(got) == 10


def test_infinitives_of_a_form(spark):
    # what the rule gives back, words or not
    assert column(spark, ["passt", "arbeitet", "Redet ", "et", "haus", None], P.weak_infinitives(F.col("word"))) == [["passen"], ["arbeiteen", "arbeiten"], ["redeen", "reden"], [], [], []]


@pytest.mark.parametrize(
    ("word", "participle", "zu", "infinitive"),
    [
        ("gemacht", True, False, "machen"), ("aufgemacht", True, False, "aufmachen"), ("gearbeitet", True, False, "arbeiten"), ("besucht", True, False, "besuchen"), ("aufzumachen", False, True, None),
        ("wiederzubeleben", False, True, None), ("gefahren", True, False, None), ("abgefahren", True, False, "abfahren"), ("verloren", False, False, "verlieren"), ("haus", False, False, None), ("zurückgelegt", True, False, "zurücklegen"), ("", False, False, None),
    ],
)
def test_shapes_of_verbs(spark, word, participle, zu, infinitive):
    known = spark.createDataFrame([("verloren", "verlieren"), ("gefahren", "fahren")] if word != "gefahren" else [("x", "y")], "participle string, infinitive string")
    df = spark.createDataFrame([(word, 1)], "word string, extra int")
    r = P.with_participle_infinitives(df.withColumns({"p": P.participle_shape(F.col("word")), "z": P.zu_infinitive_shape(F.col("word"))}), known).first()
    assert (r.p, r.z, r.infinitive, r.extra) == (participle, zu, infinitive, 1)


def test_plurals(spark):
    got = dict(zip(["Haus", "Baum", "Ball", "Katze", "Kuh", "Fenster"], map(set, column(spark, ["Haus", "Baum", "Ball", "Katze", "Kuh", "Fenster"], P.noun_plurals(F.col("word"))))))
    assert {"Häuser", "Hause", "Hausn"} <= got["Haus"] and "Bäume" in got["Baum"] and "Katzen" in got["Katze"] and "Kühe" in got["Kuh"] and "Fenster" in got["Fenster"]
    assert "Balln" not in got["Ball"] and "Bällen" not in got["Ball"] and "Bälle" in got["Ball"]


def test_cells_that_a_phrase_shares(spark):
    rows = [("a", "Dem", "alten", "alt"), ("b", "ein", "altes", "alt"), ("c", "der", "altes", "alt"), ("d", "mein", "alter", "alt"), ("e", "die", "junge", "alt")]
    got = {}
    for r in P.phrase_cells(spark.createDataFrame(rows, "id string, article string, adjective string, lemma string"), spark).collect():
        got.setdefault(r.id, set()).add((r.case, r.gender, r.number))
    assert got == {"a": {("Dat", "Masc", "Sing"), ("Dat", "Neut", "Sing")}, "b": {("Nom", "Neut", "Sing"), ("Acc", "Neut", "Sing")}, "d": {("Nom", "Masc", "Sing")}}
