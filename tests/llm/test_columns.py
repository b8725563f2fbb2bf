"""Odd rows and clashing names of columns, in each operator and through all stages of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import mixing, quality, sharding, simhash, substrings
from tests.llm.test_llm import SF, docs_of

NAMES = ["_source", "rate", "marks", "_doc", "_spans", "_start", "_place", "_bucket", "_row", "_n", "_words", "_n_words", "_places", "fp", "component_id", "copies", "size", "target", "_copy"]


def clashing(docs):
    return docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in NAMES})


def unchanged(rows):
    return all(r[n] is None or r[n] == f"{n} of {r.doc_id}" for r in rows for n in NAMES)


def letters(n):
    return "".join(chr(97 + int(c)) for c in str(n)) + "est"


TEXTS = [None, "", " ", "one two three", "word " * 80, *[" ".join(letters((i * 7 + j) % 91 + 1000 * j) for j in range(120)) for i in range(5)], "the same " * 20 + " ".join(map(letters, range(90))), "z" * 60_000]
ROWS = TEXTS + [(4, TEXTS[5]), (5, TEXTS[5]), (5, TEXTS[5]), (None, TEXTS[6]), (None, None)]


@pytest.mark.parametrize("operator", [mixing.mix, substrings.without_repeats, quality.keep_good, simhash.keep_first, quality.judged], ids=lambda f: f.__name__)
def test_columns_stay_whatever_their_names(spark, operator):
    docs = clashing(docs_of(spark, ROWS))
    got = operator(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and unchanged(got.collect())
    plain = operator(docs.drop(*NAMES))
    told = (lambda r: str(r.doc_id)) if operator is simhash.keep_first else str  # of rows with one id, a hash of the whole row chooses
    assert sorted(map(told, got.drop(*NAMES).collect())) == sorted(map(told, plain.collect()))
    assert operator(docs.limit(0)).collect() == []


def test_shards_keep_clashing_columns(spark, tmp_path):
    docs = clashing(docs_of(spark, ROWS))
    got = sharding.shuffled_shards(docs, f"file://{tmp_path}/a", shards=3, bucket_bytes=1_000)
    assert got.columns == [*docs.columns, "slot", "shard"] and unchanged(got.collect()) and got.count() == len(ROWS)
    assert {r.doc_id for r in got.where("text is null").collect()} == {0, None}


def test_ids_of_other_kinds_are_refused(spark):
    with pytest.raises(TypeError):
        substrings.without_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_stages_take_odd_rows(spark):
    held = clashing(docs_of(spark, ROWS))
    columns = held.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.stored(stage(spark, held, SF), "odd")
        assert held.columns == columns and unchanged(held.collect()), name
    assert held.where("doc_id in (5, 6, 7, 8, 9)").count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in held.collect()}
    empty = clashing(docs_of(spark, ROWS)).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []
