"""Validation of carriers: each reason on a sentence parsed by hand, agreement case by case, and odd rows."""

import pytest

from lexspark.operators import carriers
from lexspark.plans.carrier_queries import SENTENCES, dictionary, tokens_of

SCHEMA = "source string, line_id string, text string, tokens array<struct<i:int,text:string,lemma:string,pos:string,tag:string,dep:string,head:int,morph:map<string,string>>>"


def row(line, sentence, text=None):
    tokens = [{**x, "text": "Haus" if x["text"] == "*" else x["text"]} for x in tokens_of(sentence)]
    fields = ("i", "text", "lemma", "pos", "tag", "dep", "head", "morph")
    return "s", line, text or " ".join(x["text"] for x in tokens), [tuple(x[f] for f in fields) for x in tokens]


def reasons(spark, rows, words=True):
    held = carriers.validated(spark.createDataFrame(rows, SCHEMA), dictionary(spark) if words else None)
    return {r["line_id"]: r["reason"] for r in held.collect()}


def test_each_reason(spark):
    got = reasons(spark, [row(k, s) for k, s in SENTENCES.items()])
    assert got == {k: None if k.startswith("fine") else k for k in SENTENCES}
    assert set(carriers.REASONS) - set(got) == {"empty_sentence"}


VERB = "{} {} VERB VVFIN ROOT 1 Mood={}|Tense={}|Person={}|Number={}"
PERSONS = {"ich": "1|Number=Sing", "du": "2|Number=Sing", "er": "3|Number=Sing", "wir": "1|Number=Plur", "ihr": "2|Number=Plur"}


@pytest.fixture(scope="module")
def agreed(spark):
    cases = {
        ("ich", "sang", "singen", "Ind", "Past", 3, "Sing"): None,
        ("ich", "singt", "singen", "Ind", "Pres", 3, "Sing"): "subject_verb_disagreement",
        ("wir", "singen", "singen", "Ind", "Past", 3, "Plur"): None,
        ("ihr", "singt", "singen", "Ind", "Pres", 3, "Sing"): None,
        ("ihr", "sang", "singen", "Ind", "Past", 3, "Sing"): "subject_verb_disagreement",
        ("du", "heizt", "heizen", "Ind", "Pres", 3, "Sing"): None,
        ("du", "singt", "singen", "Ind", "Pres", 3, "Sing"): "subject_verb_disagreement",
        ("du", "singst", "singen", "Ind", "Pres", 3, "Plur"): None,
        ("ich", "sei", "sein", "Sub", "Pres", 3, "Sing"): None,
    }
    rows = [
        row(str(n), f"{p.title()} {p} PRON PPER sb 1 PronType=Prs|Person={PERSONS[p]}/{VERB.format(form, lemma, mood, tense, person, number)}/dort dort ADV ADV mo 1/. -- PUNCT $. punct 1")
        for n, (p, form, lemma, mood, tense, person, number) in enumerate(cases)
    ]
    got = reasons(spark, rows, words=False)
    return {k: (got[str(n)], v) for n, (k, v) in enumerate(cases.items())}


def test_forms_that_one_spelling_shares(agreed):
    assert {k: a for k, (a, _) in agreed.items()} == {k: b for k, (_, b) in agreed.items()}


def test_odd_rows(spark):
    fine = row("x", SENTENCES["fine"])
    rows = [("s", "null", None, None), ("s", "blank", "  ", []), ("s", "none", "Er geht.", None), (None, "source", fine[2], fine[3]), fine]
    bad_head = [(*t[:6], 99, None) for t in fine[3]]
    got = reasons(spark, [*rows, ("s", "heads", fine[2], bad_head)])
    assert got == {"null": "empty_sentence", "blank": "empty_sentence", "none": "fragment_too_short", "source": None, "x": None, "heads": "no_subject_found"}
    assert carriers.validated(spark.createDataFrame([], SCHEMA), dictionary(spark)).count() == 0


def test_tag_question_and_credit(spark):
    held = "Du du PRON PPER sb 1 PronType=Prs|Person=2|Number=Sing/kommst kommen VERB VVFIN ROOT 1 Mood=Ind|Tense=Pres|Person=2|Number=Sing/heute heute ADV ADV mo 1/, -- PUNCT $, punct 1/oder oder CCONJ KON cd 1/? -- PUNCT $. punct 1"
    got = reasons(spark, [row("oder", held), row("credit", SENTENCES["fine"], "Der alte Mann wartet ( Foto : Haus ) heute .")], words=False)
    assert got == {"oder": None, "credit": "colon_joined_fragment"}


def test_shape_of_names_and_numbers(spark):
    from pyspark.sql import functions as F

    from lexspark.functions.text import shape_reason

    cases = {
        "Herr Weiss kommt.": None, "Er ist weiss.": "swiss_spelling", "Sie kostet 1'000 Franken.": "swiss_spelling", "Die Gross kommt.": None, "3 Männer warten…": None,
        "Ich weiß es.": None, "Jenseits davon liegt es.": None, "Das geht\" sagte er.": "opens_mid_quotation", "Er sagte: „Komm“.": None, "Die Strassen sind leer.": "swiss_spelling",
    }
    held = spark.createDataFrame([(k,) for k in cases], "text string").select("text", shape_reason(F.col("text")).alias("reason"))
    assert {r["text"]: r["reason"] for r in held.collect()} == cases


def test_words_are_looked_up_once_for_equal_rows(spark, monkeypatch):
    """Sentences stay where they are: rows of words that are asked for are told apart, looked up and broadcast; many of them are joined by a shuffle with the same result."""
    written = []
    keep = carriers.stored
    monkeypatch.setattr(carriers, "stored", lambda df: written.append(keep(df)) or written[-1])
    unreal = "Ich ich PRON PPER sb 1 PronType=Prs|Person=1|Number=Sing/quaxle quaxlen VERB VVFIN ROOT 1 Mood=Ind|Tense=Pres|Person=1|Number=Sing/heute heute ADV ADV mo 1/. -- PUNCT $. punct 1"
    rows = [row(str(i), unreal) for i in range(3)]
    got = reasons(spark, rows)
    assert set(got.values()) == {"finite_verb_not_a_real_word"} and len(got) == 3
    assert written[1].columns == ["asked", "rule"] and written[1].count() == 1
    monkeypatch.setattr(carriers, "BROADCAST_ASKED", -1)
    assert reasons(spark, rows) == got
