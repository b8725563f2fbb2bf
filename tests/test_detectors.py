"""Detectors on sentences parsed by hand, with what taggers get wrong, and their odd inputs."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import detectors, trees

SCHEMA = "source string, line_id string, text string, tokens array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,idx:int,morph:map<string,string>>>"
FIN = "VerbForm=Fin|Tense=Pres|Person={}|Number={}"
THIRD, FIRST = FIN.format(3, "Sing"), FIN.format(1, "Sing")


def sentence(line, text, source="s"):
    """One token a line: text lemma pos dep head morph."""
    tokens, idx = [], 0
    for i, row in enumerate(x.split() for x in text.strip().split("\n")):
        word, lemma, pos, dep, head, *morph = row
        tokens.append((i, word, lemma, pos, dep, int(head), idx, dict(kv.split("=") for kv in (morph[0].split("|") if morph else []))))
        idx += len(word) + 1
    return source, line, " ".join(t[1] for t in tokens), tokens


SENTENCES = {
    "wait": f"Ich ich PRON sb 1 Person=1|Number=Sing\nwarte warten VERB ROOT 1 {FIRST}\nauf auf ADP op 1\nden der DET nk 4 Case=Acc\nBus Bus NOUN nk 2 Case=Acc|Number=Sing",
    "saturday": f"Das der PRON sb 1\nfindet finden VERB ROOT 1 {THIRD}\nam an ADP mo 1 Case=Dat\nSamstag Samstag NOUN nk 2 Case=Dat\nstatt statt ADP svp 1",
    "glad": f"Wir wir PRON sb 1 Person=1|Number=Plur\nfreuen freuen VERB ROOT 1 {FIN.format(1, 'Plur')}\nuns wir PRON oa 1 Reflex=Yes\nüber über ADP op 1\ndeine dein DET nk 5\nHilfe Hilfe NOUN nk 3 Case=Acc",
    "sat": f"Er er PRON sb 1 Person=3|Number=Sing\nhat haben AUX ROOT 1 {THIRD}\nsich sich PRON oa 5 Reflex=Yes\nauf auf ADP mo 5\nSteine Stein NOUN nk 3 Case=Acc\ngesetzt setzen VERB oc 1 VerbForm=Part",
    "wrong person": f"Er er PRON sb 1 Person=3|Number=Sing\nsieht sehen VERB ROOT 1 {THIRD}\nmich ich PRON oa 1",
    "each other": f"Sie sie PRON sb 1 Person=3|Number=Plur\nhelfen helfen VERB ROOT 1 {FIN.format(3, 'Plur')}\nsich sich PRON da 1 Reflex=Yes\ngegenseitig gegenseitig ADV mo 1",
    "up": f"Er er PRON sb 1 Person=3|Number=Sing\nsteht stehen VERB ROOT 1 {THIRD}\nfrüh früh ADV mo 1 Degree=Pos\nauf auf ADP svp 1\n. -- PUNCT punct 1",
    "will get up": f"Er er PRON sb 1\nwill wollen AUX ROOT 1 {THIRD}\naufstehen aufstehen VERB oc 1 VerbForm=Inf",
    "on and off": f"Er er PRON sb 1\ngeht gehen VERB ROOT 1 {THIRD}\nauf auf ADP svp 1\nund und CCONJ cd 2\nab ab ADP cj 2",
    "von aus": f"Er er PRON sb 1\nruft rufen VERB ROOT 1 {THIRD}\nvon von ADP mo 1\nWien Wien NOUN nk 2 Case=Dat\naus aus ADP svp 1",
    "davon": f"Er er PRON sb 1\nläuft laufen VERB ROOT 1 {THIRD}\ndavon davon ADV svp 1",
    "decide": f"Wir wir PRON sb 1\nhaben haben AUX ROOT 1 {FIN.format(1, 'Plur')}\neine ein DET nk 3\nWahl Wahl NOUN oa 4 Case=Acc|Number=Sing\ngetroffen treffen VERB oc 1 VerbForm=Part",
    "hungry": f"Ich ich PRON sb 1\nhabe haben AUX ROOT 1 {FIRST}\nHunger Hunger NOUN oa 1 Case=Acc|Number=Sing",
    "there is": f"Es es PRON ep 1\ngibt geben VERB ROOT 1 {THIRD}\nHoffnung Hoffnung NOUN oa 1 Case=Acc",
    "available": f"Das der PRON sb 1\nsteht stehen VERB ROOT 1 {THIRD}\nzur zu ADP cvc 1 Case=Dat\nVerfügung Verfügung NOUN nk 2 Case=Dat",
    "coffee": f"Ich ich PRON sb 1\ntrinke trinken VERB ROOT 1 {FIRST}\nstarken stark ADJ nk 3 Case=Acc|Number=Sing|Degree=Pos\nKaffee Kaffee NOUN oa 1 Case=Acc|Number=Sing",
    "bank": f"Die der DET nk 2\nDeutsche deutsch ADJ nk 2 Degree=Pos\nBank Bank NOUN sb 3\nwächst wachsen VERB ROOT 3 {THIRD}",
    "serious": f"Sie sie PRON sb 1\nnimmt nehmen VERB ROOT 1 {THIRD}\nihn er PRON oa 1\nernst ernst ADV mo 1\nund und CCONJ cd 1\nsehr sehr ADV mo 1",
    "like": f"Er er PRON sb 1\ngilt gelten VERB ROOT 1 {THIRD}\nals als ADP op 1\nHeld Held NOUN nk 2 Case=Nom",
    "said": f"Er er PRON sb 1\nsagt sagen VERB ROOT 1 {THIRD}\ner er PRON sb 4\nnehme nehmen VERB oc 1 VerbForm=Fin|Mood=Sub|Tense=Pres|Person=3|Number=Sing\nHilfe Hilfe NOUN oa 3 Case=Acc",
    "muss": f"Er er PRON sb 1\nmuss muss VERB ROOT 1 {THIRD}\nauf auf ADP op 1\nHilfe Hilfe NOUN nk 2 Case=Dat\nhoffen hoffen VERB oc 1 VerbForm=Inf",
}


@pytest.fixture(scope="module")
def found(spark):
    parsed = spark.createDataFrame([sentence(k, v) for k, v in SENTENCES.items()] + [("s", "none", None, None), ("s", "empty", "", [])], SCHEMA)
    words = "warten freuen setzen finden stehen aufstehen stattfinden treffen geben trinken wachsen nehmen gelten laufen davonlaufen rufen gehen helfen sehen sagen hoffen".split()
    dictionary = spark.createDataFrame([(w,) for w in words], "word string")
    rows = detectors.detected(parsed, dictionary).collect()
    return {line: sorted((r.kind, r.unit_key, [t.text for t in r.tokens], r.form_key, r.case) for r in rows if r.line_id == line and r.kind not in {"noun", "verb", "adjective"}) for line in [*SENTENCES, "none", "empty"]}, rows


def of(found, line):
    return [x[:3] for x in found[0][line]]


def test_verbs_with_prepositions(found):
    assert found[0]["wait"] == [("verb_prep", "warten auf", ["warte", "auf"], "Fin|Pres|1|Sing", "Akk")]
    assert of(found, "saturday") == [("separable_verb", "stattfinden", ["findet", "statt"])]
    assert found[0]["like"] == [("verb_prep", "gelten als", ["gilt", "als"], "Fin|Pres|3|Sing", None)]
    assert of(found, "muss") == [("verb_prep", "hoffen auf", ["auf", "hoffen"])]


def test_reflexive_verbs(found):
    assert found[0]["glad"] == [("reflexive_verb", "sich freuen", ["freuen", "uns"], "Fin|Pres|1|Plur", None), ("reflexive_verb", "sich freuen über", ["freuen", "uns", "über"], "Fin|Pres|1|Plur", "Akk")]
    assert of(found, "sat") == [("reflexive_verb", "sich setzen", ["sich", "gesetzt"]), ("reflexive_verb", "sich setzen auf", ["sich", "auf", "gesetzt"])]
    assert of(found, "wrong person") == [] and of(found, "each other") == [("adj_verb", "gegenseitig helfen", ["helfen", "gegenseitig"])]


def test_separable_verbs(found):
    assert ("separable_verb", "aufstehen", ["steht", "auf"]) in of(found, "up")
    assert found[0]["will get up"] == [("separable_verb", "aufstehen", ["aufstehen"], "Inf|fused", None)]
    assert of(found, "on and off") == [] and [x for x in of(found, "von aus") if x[0] == "separable_verb"] == []
    assert of(found, "davon") == [("separable_verb", "davonlaufen", ["läuft", "davon"])]


def test_collocations(found):
    assert of(found, "decide") == [("noun_verb", "wahl treffen", ["Wahl", "getroffen"])]
    assert of(found, "hungry") == [("noun_verb", "hunger haben", ["habe", "Hunger"])]
    assert of(found, "there is") == []
    assert of(found, "available") == [("noun_verb", "zur verfügung stehen", ["steht", "zur", "Verfügung"])]
    assert ("adj_noun", "stark kaffee", ["starken", "Kaffee"], "Acc|Sing", None) in found[0]["coffee"]
    assert of(found, "bank") == []
    assert of(found, "serious") == [("adj_verb", "ernst nehmen", ["nimmt", "ernst"])]
    assert ("adj_verb", "früh aufstehen", ["steht", "früh", "auf"]) in of(found, "up")


def test_single_words_and_reported_speech(found):
    words = {(r.line_id, r.kind, r.unit_key) for r in found[1] if r.kind in {"noun", "verb", "adjective"}}
    assert {("wait", "verb", "warten"), ("wait", "noun", "bus"), ("coffee", "adjective", "stark"), ("said", "verb", "nehmen")} <= words
    assert not any(line in {"up", "will get up"} and kind == "verb" for line, kind, _ in words)
    assert {r.line_id for r in found[1] if r.evidence.get("k1_sentence")} == {"said"}
    assert found[0]["none"] == found[0]["empty"] == []


def test_words_of_a_gate(spark, found):
    parsed = spark.createDataFrame([sentence(str(i), SENTENCES["coffee"].replace("Kaffee Kaffee", "Fuß Fuß"), "a" if i < 5 else "b") for i in range(8)], SCHEMA)
    words = detectors.detected(parsed, None, ("single_words",))
    lemmas = spark.createDataFrame([("fuss",), ("trinken",)], "word string")
    got = detectors.word_occurrences(words, lemmas, parsed.select("text"), cap=2)
    assert sorted((r.unit_key, r.source, r.line_id) for r in got.collect()) == sorted((w, s, i) for w in ("fuß", "trinken") for s, i in (("a", "0"), ("a", "1"), ("b", "5"), ("b", "6")))
    assert detectors.word_occurrences(words, lemmas.limit(0), parsed.select("text")).count() == 0


def test_lemmas_of_taggers_are_repaired_or_dropped(spark):
    pairs = spark.createDataFrame([("erinneren", ""), ("muss", ""), ("stehen", "auf"), ("aufstehen", ""), ("hinzukommen", ""), ("verstehen", ""), ("xyzen", "")], "lemma string, particle string")
    words = spark.createDataFrame([(w,) for w in ("erinnern", "stehen", "aufstehen", "kommen", "hinkommen", "zukommen")], "word string")
    got = {r.lemma: (r.base, r.fuses, r.fused) for r in detectors.verb_facts(pairs, words).collect()}
    assert got["erinneren"] == ("erinnern", False, False) and got["muss"][0] == "" and got["stehen"] == ("stehen", True, False) and got["aufstehen"] == ("aufstehen", True, True)
    assert got["hinzukommen"][2] is False and got["verstehen"][2] is False and got["xyzen"][0] == ""
    assert {r.lemma: r.base for r in detectors.verb_facts(pairs).collect()}["xyzen"] == "xyzen"


def test_heads_that_lead_nowhere(spark):
    rows = [("s", "1", "x", [(0, "auf", "auf", "ADP", "op", 7, 0, {}), (1, "geht", "gehen", "VERB", "ROOT", -2, 4, None)])]
    t = trees.with_trees(spark.createDataFrame(rows, SCHEMA)).first()
    assert t.verb == [-1, -1] and detectors.detected(spark.createDataFrame(rows, SCHEMA)).where(F.col("kind") != "verb").count() == 0


def test_no_tree_is_stored(spark, monkeypatch):
    """Walks are made at candidates alone: only candidates and facts about verbs are written, and a sentence without candidates leaves nothing."""
    written = []
    keep = detectors.stored
    monkeypatch.setattr(detectors, "stored", lambda df: written.append(df) or keep(df))
    parsed = spark.createDataFrame([sentence("wait", SENTENCES["wait"]), sentence("coffee", SENTENCES["coffee"])], SCHEMA)
    assert [r.unit_key for r in detectors.detected(parsed, None, ("verb_prep",)).collect()] == ["warten auf"]
    assert len(written) == 2 and not {"t", "kids", "verb"} & {c for df in written for c in df.columns} and written[0].count() == 1


def test_trees_and_walks_agree(spark):
    parsed = spark.createDataFrame([sentence(k, v) for k, v in SENTENCES.items()], SCHEMA)
    t = trees.with_trees(parsed).where("line_id = 'will get up'").first()
    assert (t.verb, t.clause, [len(k) for k in t.kids], t.particle, t.finite) == ([2, 2, 2], [-1, 2, -1], [0, 2, 0], [None] * 3, [1, 1, 1])
    up = trees.with_trees(parsed).where("line_id = 'up'").first()
    assert [p and (p.i, p.low, p.needs) for p in up.particle] == [None, (3, "auf", False), None, None, None] and up.subject[1] == {"Person": "3", "Number": "Sing"}
