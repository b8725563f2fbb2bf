"""Files and joins of stages and devices."""

import datetime as dt
import json
import random

import pytest
from pyspark.errors import PySparkException

from lexspark.operators import detectors
from lexspark.sources import deck, exchange
from tests.test_detectors import SCHEMA, SENTENCES, sentence


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_occurrences_come_back(spark, tmp_path):
    found = detectors.detected(spark.createDataFrame([sentence(k, SENTENCES[k]) for k in ("wait", "up")], SCHEMA))
    exchange.write_occurrences(found.where("kind = 'verb_prep'"), f"file://{tmp_path}/a")
    exchange.write_occurrences(found.where("kind <> 'verb_prep'"), f"file://{tmp_path}/b")
    got = exchange.read_occurrences(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").select(found.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, found.collect())) and exchange.read_occurrences(spark).count() == 0


def test_glosses_are_written_once_and_in_order(spark, tmp_path):
    at = lambda n: dt.datetime(2026, 1, n)
    rows = [("b", "old", "x", at(1)), ("b", "new", "x", at(2)), ("a", "one", "y", at(1)), (None, "none", "x", at(1)), ("c", None, "x", at(1)), ("a", "one", "y", at(1))]
    df = spark.createDataFrame(rows, "german string, english string, source string, written_at timestamp")
    for name, n in (("p", 1), ("q", 5)):
        exchange.write_glosses(df.repartition(n), f"file://{tmp_path}/{name}")
    files = [sorted(x.read_bytes() for x in (tmp_path / n).glob("part-*")) for n in "pq"]
    assert files[0] == files[1] and [json.loads(x)["english"] for x in b"".join(sorted((tmp_path / "p").glob("part-*"), key=str) and files[0]).decode().split("\n") if x] == ["one", "new"]
    with pytest.raises(PySparkException):
        exchange.write_glosses(df, f"file://{tmp_path}/p")


def test_carriers_and_dictionary(spark, tmp_path):
    path = put(tmp_path / "c.txt", "s\t 12\tEin Satz.\r\nNur ein Satz.\n\n a\tb \n")
    assert sorted(tuple(r) for r in exchange.wanted_carriers(spark, path).collect()) == [("", "", "Nur ein Satz."), ("", "", "b"), ("s", "12", "Ein Satz.")]
    assert sorted(r.word for r in exchange.dictionary(spark, put(tmp_path / "d.txt", "Fuß\nfuss \n\nHaus\n")).collect()) == ["fuss", "haus"]


@pytest.mark.parametrize("size", ["64", "1000", "1m"])
def test_concatenated_json_in_any_splits(spark, tmp_path, size):
    rng = random.Random(5)
    rows = [{"a": i, "b": rng.choice(["plain", "br}ace{s", 'quo"te', "back\\slash\\", "line\nend", "ü\U0001f600", "}{", '\\"}']), "c": {"d": [i, {"e": "}"}]}} for i in range(120)]
    text = "".join(json.dumps(r, ensure_ascii=i % 2 == 0) + rng.choice(["", "\n", " ", "\r\n\n"]) for i, r in enumerate(rows)) + '{"a": 7, "b": "cut'
    path = put(tmp_path / "log.json", text)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        good, bad = exchange.concatenated_json(spark, path, "a INT, b STRING, c STRUCT<d: ARRAY<STRING>>")
        got = {r.a: (r.b, r.c.d) for r in good.collect()}
        assert [r.text for r in bad.collect()] == ['{"a": 7, "b": "cut']
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {r["a"]: (r["b"], [str(r["a"]), '{"e":"}"}']) for r in rows}


LOG = "learner string, type string, unit_id string, ts timestamp, seq long, rating int, review_ts timestamp"


def test_corrections_rewrite_the_past(spark):
    at = lambda n: dt.datetime(2026, 1, 1, 0, n)
    rows = [("l", "review", "u", at(1), 1, 1, None), ("l", "review", "u", at(2), 2, 1, None), ("l", "correction", "u", at(9), 5, 3, at(1)), ("l", "correction", "u", at(8), 4, 2, at(1)), ("l", "correction", "x", at(8), 6, 2, at(1)), ("l", "reset", None, at(3), 3, None, None), ("m", "review", "u", at(1), 1, 1, None)]
    for order in (rows, rows[::-1]):
        got = sorted((r.learner, r.seq, r.rating) for r in exchange.corrected(spark.createDataFrame(order, LOG)).collect())
        assert got == [("l", 1, 3), ("l", 2, 1), ("l", 3, None), ("m", 1, 1)]


def test_logs_are_numbered_on_and_split_by_mode(spark, tmp_path):
    at = lambda n: dt.datetime(2026, 1, 1, 0, n)
    entries = spark.createDataFrame([("l", "review", "u", at(2), 0, 3, None), ("l", "review", "pf:v", at(1), 0, 3, None), ("m", "reset", None, at(1), 0, None, None)], LOG)
    first = exchange.append_log(entries, f"file://{tmp_path}/log")
    exchange.append_log(entries, f"file://{tmp_path}/log", first)
    got = spark.read.schema(LOG).json(f"file://{tmp_path}/log")
    assert sorted((r.learner, r.seq, r.unit_id or "") for r in got.collect()) == [("l", 1, "pf:v"), ("l", 2, "u"), ("l", 3, "pf:v"), ("l", 4, "u"), ("m", 1, ""), ("m", 2, "")]
    assert {r.unit_id for r in exchange.entries_of_mode(got, True).collect()} == {"pf:v", None} and {r.unit_id for r in exchange.entries_of_mode(got, False).collect()} == {"u", None}


def test_ids_join_in_their_own_corpus_only(spark):
    lines = spark.createDataFrame([("own", "1", "Eins."), ("other", "1", "Etwas ganz anderes."), ("other", "9", "Zwei."), ("", "1", "Unbekannt."), ("own", "7", "Nichts.")], "source string, line_id string, text string")
    pairs = spark.createDataFrame([("1", "Eins.", "One, and more."), ("1", "Eins.", "One."), ("2", "Zwei.", "Two.")], "id string, german string, english string")
    held = exchange.paired_glosses(lines, pairs, "own")
    assert {r.text: r.english for r in exchange.guard(held, pairs, "own").collect()} == {"Eins.": "One.", "Etwas ganz anderes.": None, "Zwei.": "Two.", "Unbekannt.": None, "Nichts.": None}
    mixed = lines.join(pairs.groupBy("id").agg({"english": "min"}).toDF("line_id", "english"), "line_id", "left").select("source", "line_id", "text", "english")
    with pytest.raises(PySparkException, match="gloss of another corpus by id: other 1"):
        exchange.guard(mixed, pairs, "own").collect()


def test_decks_come_back_and_issues_are_told(spark, tmp_path):
    units = spark.createDataFrame([("u1", 1, "haus", "das Haus", "house"), ("u2", 300, "baum", "der Baum", "tree")], "unit_id string, rank long, lemma_key string, display string, gloss string")
    cards = spark.createDataFrame([("c1", "u1", "Das Haus und das Haus.", [(4, 8), (17, 21)]), ("c2", "u2", "Ein Baum.", [])], "card_id string, unit_id string, sentence string, gaps array<struct<start:int,end:int>>")
    deck.export(cards, units, f"file://{tmp_path}/deck")
    kinds = [", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for df in (cards, units)]
    got = exchange.read_deck(spark, f"file://{tmp_path}/deck", *kinds)
    assert all(sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())) for a, b in zip(got, (cards, units)))
    issues = spark.createDataFrame([(1, "u1", "c1", "odd"), (2, "gone", "c9", None)], "ts int, unit_id string, card_id string, note string")
    told = {r.ts: (r.display, r.sentence, r.gone) for r in exchange.issue_reports(issues, units, cards).collect()}
    assert told == {1: ("das Haus", "Das [Haus] und das [Haus].", []), 2: (None, None, ["unit", "card"])}
