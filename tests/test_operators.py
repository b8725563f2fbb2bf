"""Operators against sequential versions and hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import cards, ngrams
from lexspark.sources import deck, readers


def greedy(rows, slots):
    """The pick one card at a time, re-sorting after each."""
    chosen, taken = [], set()
    for kept in (True, False):
        left = sorted((r for r in rows if r["kept"] == kept), key=lambda r: r["ord"])
        while left and len(chosen) < slots:
            left.sort(key=lambda r: r["score"] + (25.0 if r["form_key"] in taken else 0.0))
            row = left.pop(0)
            chosen.append(row["ord"])
            taken.add(row["form_key"])
    return chosen


def test_picked_is_the_greedy_pick(spark):
    rng = random.Random(4)
    rows = [
        {"unit_id": u, "ord": o, "form_key": rng.randrange(4), "score": float(rng.choice([40, 45, 50, 65, 70])), "kept": rng.random() < 0.3}
        for u in range(300) for o in range(rng.randrange(1, 12))
    ]
    got = cards.picked(spark.createDataFrame(rows), F.lit(4)).orderBy("unit_id", "place").collect()
    by_unit: dict[int, list[int]] = {}
    for r in got:
        by_unit.setdefault(r.unit_id, []).append(r.ord)
    for u in range(300):
        assert sorted(by_unit[u]) == sorted(greedy([r for r in rows if r["unit_id"] == u], 4)), u


def test_without_contained_is_the_sequential_rule(spark):
    rng = random.Random(1)
    texts = list({" ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(2, 5))) for _ in range(60)})
    rows = [(t, rng.randrange(5, 40), float(rng.randrange(3, 8))) for t in texts]
    kept: list[tuple[str, int, float]] = []
    for t, n, s in sorted(rows, key=lambda r: (-r[2], -r[1], r[0])):
        if not any(t in o and n <= 1.25 * m for o, m, _ in kept):
            kept.append((t, n, s))
    got = ngrams.without_contained(spark.createDataFrame(rows, "text string, n long, score double")).collect()
    assert {r.text for r in got} == {t for t, _, _ in kept}


def test_grown_takes_the_longer_span(spark):
    grams = spark.createDataFrame([("erster linie", 766), ("in erster linie", 763), ("haus gebracht", 1088), ("ins haus gebracht", 503)], "ngram string, n long")
    scored = spark.createDataFrame([("erster linie", 766, 8.0), ("haus gebracht", 1088, 7.0)], "ngram string, n long, score double")
    assert {(r.text, r.n) for r in ngrams.grown(scored, grams).collect()} == {("in erster linie", 763), ("haus gebracht", 1088)}


def test_hosting_once(spark):
    df = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b"), ("v", "b")], "unit_id string, text string")
    assert {tuple(r) for r in cards.hosting_once(df).collect()} == {("u", "a"), ("v", "b")}


@pytest.mark.parametrize(
    ("accepted", "typed", "slip"),
    [("verstehen", "vertsehen", True), ("verstehen", "verstehn", False), ("verstehen", "verztehen", True), ("haus", "maus", True), ("die", "dei", False), ("gehen", "gehst", False)],
)
def test_typo(spark, accepted, typed, slip):
    assert spark.range(1).select(X.typo(F.lit(typed), F.lit(accepted)).alias("x")).first().x is slip


def test_text_functions(spark):
    row = spark.range(1).select(
        X.slug(F.lit(" Größe & Maß! ")).alias("slug"), X.normalise(F.lit(" Straße ")).alias("n"), X.reserve_letter(F.lit("Übung")).alias("l"), X.reserve_letter(F.lit("3x")).alias("o"),
        X.gloss_senses(F.lit("to go; (fig.) a walk, the go")).alias("s"), X.plausible(F.lit("Das ist ein ganz normaler Satz.")).alias("p"), X.shape_reason(F.lit("das geht nicht.")).alias("r"),
        X.compound_splits(F.lit("haustüren")).alias("c"), cards.answer_leaks(F.lit("Er geht, sie geht"), F.array(F.lit("geht"))).alias("k"),
    ).first()
    assert (row.slug, row.n, row.l, row.o, row.s, row.p, row.r, row.k) == ("groesse_mass", "strasse", "u", "_", ["go", "walk"], True, "not_capitalized", True)
    assert [tuple(x) for x in row.c] == [("haus", "türen"), ("haust", "üren")]


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\tdeu\tEin Satz.\n2\tdeu\n3\tdeu\tNoch einer.\n")
    got = readers.corpus_lines(spark, str(tmp_path / "t.tsv"), "tatoeba", "t").collect()
    assert [(r.line_id, r.text) for r in got] == [("1", "Ein Satz."), ("3", "Noch einer.")]
    (tmp_path / "l.tsv").write_text("7\tMit Nummer.\nOhne Nummer.\n\n")
    assert {(r.line_id, r.text) for r in readers.corpus_lines(spark, str(tmp_path / "l.tsv"), "lines", "l").collect()} == {("7", "Mit Nummer."), ("", "Ohne Nummer.")}
    (tmp_path / "g.jsonl").write_text('{"german": "a", "english": "x", "source": "azure", "written_at": "2024-01-01T00:00:00Z"}\nbroken\n{"german": "a", "english": "y", "source": "gemini", "written_at": "2024-01-02T00:00:00Z"}\n')
    assert [(r.german, r.english) for r in readers.gloss_store(spark, str(tmp_path / "g.jsonl")).collect()] == [("a", "y")]
    (tmp_path / "c.txt").write_text('{"german": "eins"}\nzwei\n')
    assert {tuple(r) for r in readers.carriers(spark, str(tmp_path / "c.txt")).collect()} == {("eins", True), ("zwei", False)}
    (tmp_path / "f.txt").write_text("der 100\nx1 50\ndie 40\nder 3\n")
    assert {tuple(r) for r in readers.frequency_ranks(spark, str(tmp_path / "f.txt")).collect()} == {("der", 1), ("die", 2)}
    (tmp_path / "b.csv").write_text('Date,SKU description,Usage amount,Unrounded subtotal ($)\n2024-01-01,Flash 2.5 input token count,"1,200",0.5\n2024-01-01,Mystery,1,1\nTotal,,,9\n')
    rows, unknown = readers.billing(spark, str(tmp_path / "b.csv"))
    assert [(r.model, r.direction, r.tokens) for r in rows.collect()] == [("flash 2.5", "input", 1200.0)]
    assert [r.sku for r in unknown.collect()] == ["Mystery"]


def test_deck_export_is_refused_and_repeats(spark, tmp_path):
    units = spark.createDataFrame([("u1", "haus", 1), ("u2", "übung", 201)], "unit_id string, lemma_key string, rank long")
    rows = spark.createDataFrame([("c1", "u1"), ("c2", "u2")], "card_id string, unit_id string")
    for name in ("a", "b"):
        deck.export(rows, units, str(tmp_path / name))
    assert {r.band for r in spark.read.json(str(tmp_path / "a/cards")).collect()} == {0, 1}
    assert spark.read.json(str(tmp_path / "a/manifest")).first() == spark.read.json(str(tmp_path / "b/manifest")).first()
    with pytest.raises(ValueError):
        deck.export(rows.union(spark.createDataFrame([("c3", "gone")], rows.schema)), units, str(tmp_path / "c"))
