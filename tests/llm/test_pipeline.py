"""The pipeline's stages, one after the other, against plain Python."""

import hashlib
import itertools
import math
import re

import numpy as np

import corpus_pipeline
from lexspark.llm import pieces, simhash
from tests.llm.test_llm import SF, components_of, slow_removal, slow_stats, words_of


def good(text):
    n, chars, symbols, again, repeated = slow_stats(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    upper, marks, digits = (len(re.findall(p, text)) for p in (r"[A-ZÀ-ÖØ-Þ]", "!", "[0-9]"))
    return not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > n or 5 * upper > 2 * chars or 5 * marks > n or chars > 12 * n or 2 * chars < 5 * n or 2 * again > len(lines) or 5 * digits > chars)


def draw(doc_id):
    return int(hashlib.md5(f"20:{doc_id}".encode()).hexdigest()[:8], 16) / 2**32


def test_rows_equal_brute_force(spark):
    rows = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {d: x for d, x in rows.items() if good(x[0])}
    ids = sorted(rows)
    fps = [simhash.fingerprint(rows[d][0]) & (1 << 64) - 1 for d in ids]
    root = components_of(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    ids = [d for i, d in enumerate(ids) if root[i] == i]
    removed = slow_removal([(d, rows[d][0]) for d in ids], 13)
    sizes = {d: removed[d][0] - removed[d][1] for d in ids}
    sources = sorted({rows[d][1] for d in ids})
    total = {s: sum(sizes[d] for d in ids if rows[d][1] == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sources)}
    low, high = 0.0, 2.0 * sum(total.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], level * weight[s]) for s in sources) < 1.5 * sum(total.values()) else (low, level)
    want = {}
    for d in ids:
        s = rows[d][1]
        rate = min(2 * total[s], high * weight[s]) / total[s] if total[s] else 0.0
        rate = round(rate, 9)
        if n := math.floor(rate) + (draw(d) < rate - math.floor(rate)):
            want[d] = n
    got = corpus_pipeline.run(spark, SF).collect()
    assert all(r.round_trip for r in got)
    count = {d: sum(r.doc_id == d and r.sample == 0 for r in got) for d in want}
    assert count == want and {r.doc_id for r in got} == set(want)
    v = pieces.vocabulary()
    for r in got:
        text = pieces.decoded(np.asarray(r.pieces), v)
        assert hashlib.sha256(" ".join(words_of(text)).encode()).hexdigest() == removed[r.doc_id][2]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.stored(stage(spark, held, SF), "x")
        assert held.columns == docs.columns and held.count() > 0
