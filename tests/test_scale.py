"""Steps that cost too much at size: what they look at, and that results stay."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import association as A
from lexspark.operators import detectors, letters, paradigms, trees
from lexspark.operators import patterns as P
from lexspark.plans import lexicon_queries, parse_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quotations_are_found_without_going_back(spark):
    """the pattern that SQL has and the one that gives nothing back agree."""
    parts = ["", "a", "Er", " ", "(", "<", "\"", "„", "“", "”", "«", "»", ".", "1", "ä"]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(3_000)] + ["Er sagte“ nichts.", "„Ja“, sagte er.", "“", "a\"", "a \"b\"", "12\" Zoll"]
    held = spark.createDataFrame([(x,) for x in texts], "text string")
    got = held.select(F.col("text").rlike(X.MID_QUOTATION).alias("a"), X.opens_mid_quotation(F.col("text")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len({r.a for r in got}) == 2


@pytest.mark.parametrize("text", ["Die STRASSE ist lang.", "Er MUSS gehen, sie heisst so.", "Es kostet 1'000 Franken.", "Es kostet 1’000 Franken.", "Das Mass ist voll.", "Er isst nass."])
def test_swiss_spelling_with_capitals(spark, text):
    """words without ss are passed over, whatever their case."""
    expected = bool(re.search(r"strasse|heisst|[0-9]['’][0-9]{3}|\bmass\b", text.lower()))
    assert spark.range(1).select(X.swiss_spelling(F.lit(text))).first()[0] is expected


def test_hits_are_worked_out_once(spark):
    """the search is no part of the plan that compares hits with each other."""
    lines = spark.createDataFrame([("1", "one two three one two"), ("2", "one two"), ("3", "")], "line_id string, text string")
    curated = spark.createDataFrame([("a", ["one", "two"], 0, None), ("b", ["one", "two", "three"], 0, None)], "key string, words array<string>, max_gap int, unless array<string>")
    held = P.longest_hits(P.pattern_hits(lines, curated))
    assert "regexp_extract_all" not in plan(held)
    assert sorted((r.key, r.line_id) for r in held.collect()) == [("a", "2"), ("b", "1")]


def test_words_of_pairs_are_extracted_once(spark):
    """pairs, single words and the total read stored words."""
    held = A.pair_association(spark.createDataFrame([("One two.",), ("One two three.",), ("",)], "text string"), 2)
    assert "regexp_extract_all" not in plan(held)
    assert [(r.a, r.b, r.pair, r.n_a, r.n_b, r.total) for r in held.collect()] == [("one", "two", 2, 2, 2, 3)]


def test_marks_are_one_flat_column():
    """lists of marks are built from flat columns; null stays null."""
    d = letters.distances(["heir", "ab"], ["hier", "abc"])
    assert [int(d[0, 4, 4]), int(d[1, 2, 3])] == [1, 1]
    found = [letters.marks("heir", "hier", d[0].tolist()), None, [], letters.marks("ab", "abc", d[1, :3, :4].tolist())]
    rows = letters._column(found).to_pylist()
    assert rows[1] is None and rows[2] == [] and rows[3] == [{"op": "same", "typed": "ab", "expected": "ab"}, {"op": "missing", "typed": "", "expected": "c"}]
    assert [m["op"] for m in rows[0]] == ["same", "swap", "same"]


def test_an_adjective_is_one_row_a_form(spark):
    """cells of a form are counted before anything is shuffled, and are those of all declined rows."""
    stems = spark.createDataFrame([("klein",), ("klein",), ("",), (None,)], "lemma string")
    got = paradigms.adjective_forms(stems)
    rows = paradigms.declined(stems).groupBy("lemma", "form").agg(F.count("*").alias("cells"), F.count_if(F.col("declension") == "strong").alias("strong"), F.min("case").alias("first_case"))
    assert sorted(got.collect()) == sorted(rows.select(*got.columns).collect()) and got.count() == 10
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in rows.select(*got.columns).schema]


def test_sentences_without_candidates_get_no_tokens(spark):
    """F8 to F10: sieves leave sentences out before tokens are made, and none that has a candidate."""
    sf = "/root/testdata/sf0.001"
    every = parse_queries.parsed(spark, sf)
    found = detectors._exploded(trees.with_tokens(every), F.concat(*[detectors.DETECTORS[k]() for k in detectors.SIEVES])).select("kind", "line_id").distinct().collect()
    n = every.count()
    for kind in detectors.SIEVES:
        held, own = {r.line_id for r in parse_queries.parsed(spark, sf, (kind,)).select("line_id").collect()}, {r.line_id for r in found if r.kind == kind}
        assert own and own <= held and len(held) < n / 2, kind


def test_equal_words_meet_their_facts_once(spark):
    """words are counted by their sentence's prefixes before they are joined to facts."""
    held = plan(lexicon_queries.words_within(spark, "/root/testdata/sf0.001"))
    assert re.search(r"Join.*(?:\n.*)*Aggregate \[word#\d+, prefixes#\d+\]", held)


def _written(monkeypatch, *modules):
    """What these modules store from now on."""
    written = []
    for module in modules:
        keep = module.stored
        monkeypatch.setattr(module, "stored", lambda df, keep=keep: written.append(keep(df)) or written[-1])
    return written


def test_only_first_words_are_kept_and_no_text_with_them(spark, monkeypatch):
    """of a word and source three glossed and three other rows at most meet the facts, and no row has its sentence."""
    written = _written(monkeypatch, detectors)
    sf = "/root/testdata/sf0.001"
    every = parse_queries.detected_single_words(spark, sf).count()
    rows = parse_queries.single_word_units(spark, sf).count()
    assert all("text" not in df.columns for df in written)
    few = next(df for df in written if "glossed" in df.columns)
    classes = few.groupBy("word", "source", "pos", "particle", "needs", "fusable", "glossed").count()
    assert classes.agg(F.max("count")).first()[0] == 3 and rows < few.count() < every


def test_words_are_cut_before_they_are_sent(spark, monkeypatch):
    """a hot word is cut to its first occurrences in each task, before the shuffle, and shuffles are by word and source alone."""
    plans, keep = [], detectors.stored
    monkeypatch.setattr(detectors, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    words = spark.range(0, 4_000, 1, 4).selectExpr("'verb' kind", "if(id < 0, 'x', 'gehen') unit_key", "'s' source", "cast(id as string) line_id", "1 i")
    got = detectors.word_occurrences(words, spark.createDataFrame([("gehen",)], "word string"), None, cap=2)
    assert sorted(r.line_id for r in got.collect()) == ["0", "1"]
    held = words.select("*", F.col("unit_key").alias("word"), F.lit("VERB").alias("pos"), F.lit("").alias("particle"), F.lit(False).alias("needs"), F.lit(False).alias("fusable"))
    assert detectors.first_candidates(held, 2).count() == 2
    assert len(plans) == 2 and all(re.search(r"Exchange(?:.*\n)+?.*WindowGroupLimit.*Partial", p) and p.count("Exchange") == 1 for p in plans)


@pytest.mark.parametrize("name", ["single_word_units", "detected_single_words"])
def test_sharp_s_and_copies_agree_with_sql(spark, tmp_path, name):
    """words with sharp s are known by their spelling with ss wherever that is a word, in sentences without a gloss too."""
    rng = np.random.default_rng(5)
    stems = [f"{a}{b}{c}" for a in ("gru", "ma", "fu", "stra", "schlo") for b in ("ß", "ss", "SS", "ẞ") for c in ("", "e", "er", "lich", "bad", "ung")] + ["Haus", "und", "aus", "von", "http", "ÄRA", "schnell"]
    texts = [" ".join(rng.choice(rng.choice(stems, 12), rng.integers(0, 90))) for _ in range(150)]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts + [x for x in texts[:30] for _ in range(4)] + ["Haus " * 16 + t for t in texts[30:60]])] + [(9_000, None, "s0"), (9_001, "", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = parse_queries.QUERIES[name](spark, str(tmp_path))
    expected = c.execute(f"SELECT {', '.join(got.columns)} FROM ({parse_queries.ORACLES[name]})").fetchall()
    assert len(expected) > 300 and sorted(map(tuple, got.collect())) == sorted(expected)
    assert any("ß" in r[1] for r in expected) and any("ss" in r[1] for r in expected)


def test_no_entry_with_ss_is_a_word(spark):
    """sentences without a gloss are passed over unless their text has ss, so no lemma of ``ENTRIES`` with ss may be a word."""
    with_ss = {(e[1], e[2]) for e in parse_queries.ENTRIES if "ss" in e[1].lower() and e[2] in detectors.WORDS}
    assert with_ss == {("muss", "VERB")}
    assert detectors.verb_facts(spark.createDataFrame([("muss", "")], "lemma string, particle string"), parse_queries.dictionary(spark)).first().base == ""


def test_glossed_sentences_are_those_with_a_glossed_text(spark, tmp_path):
    """a text that any sentence with an even place has is glossed wherever it stands; others are not."""
    run = " ".join(chr(97 + i) * 5 for i in range(16))
    texts = [(1, "x " * 16 + run), (2, run), (3, "y " * 16 + run.upper()), (4, None), (5, "")]
    spark.createDataFrame([(i, t, "s") for i, t in texts], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.line_id for r in parse_queries.single_word_units(spark, str(tmp_path)).collect()}
    assert {"1#1", "2#0"} & got and "3#1" not in got


@pytest.mark.parametrize("size", ["sf0.001", "odd"])
def test_rows_of_tokens_and_arrays_of_tokens_have_the_same_words(spark, tmp_path, size):
    """the derived rows of tokens and the derived trees come to the same single words, with particles, names and reported speech."""
    sf = f"/root/testdata/{size}"
    if size == "odd":
        rng = np.random.default_rng(3)
        parts = ["und", "von", "aus", "http", "Haus", "ßa", "ÄRA", "İx", "a", "weitergehen", "ΑΣ"]
        texts = [" ".join(rng.choice(parts, rng.integers(0, 200))) for _ in range(300)] + [None, "", "1 2", "a"]
        sf = str(tmp_path)
        spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{sf}/documents.parquet")
    words = parse_queries.dictionary(spark)
    a = parse_queries._told(detectors.detected(parse_queries.parsed(spark, sf), words, ("single_words",)))
    b = parse_queries.detected_single_words(spark, sf)
    assert b.columns == a.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and b.count() > 1_000
    if size == "odd":
        assert b.where("evidence like '%k1_sentence=true%'").count() > 0


def test_steps_over_tokens_are_short_enough_to_be_compiled(spark, monkeypatch, capsys):
    """the JVM compiles no method of more than 8,000 bytes; one that it interprets takes several times as long."""
    held, keep = [], parse_queries.stored
    monkeypatch.setattr(parse_queries, "stored", lambda df: held.append(df) or keep(df))
    monkeypatch.setattr(detectors, "first_candidates", lambda df, *_, **__: held.append(df) or keep(df))
    parse_queries.detected_single_words(spark, "/root/testdata/sf0.001")
    parse_queries.single_word_units(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans that may still change have no code to look at
    try:
        capsys.readouterr()
        for df in held:
            df.select("*").explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) == 2
