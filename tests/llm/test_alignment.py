"""Alignment of two tokenizers against a walk over the tokens of each text."""

import bisect
import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexspark.llm import alignment

SF = "/root/testdata/sf0.001"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in PLAIN)}
ODD = [
    None, "", " ", "a", "  two  blanks ", "<|endoftext|> and <s> </s> <unk> <0x0A>", "tab\tand\nline\r\n\x0b", "▁ written", " nbsp　wide", "näive äß\U0001f600\U0001f1e9",
    "x" * 40_000, " " * 3_000, "ab " * 40_000, "\x00nul", "﻿bom", "12345 67 ١٢", "don't we'll", "中文字",
]


def slow(texts):
    a_model = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    out, links, counts = [], [], Counter()
    for t in texts:
        a = [(i, bytes(BYTE[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in (b_model.encode(t) if t else [])]
        if not t or any(b"".join(x for _, x in s) != (" " + t).encode() for s in (a, b)):
            a = b = []
        ends = []
        for s in (a, b):
            at, found = 0, {}
            for i, x in s:
                at += len(x)
                found[at] = i
            ends.append(found)
        common = sorted(ends[0].keys() & ends[1].keys())
        halves = [[[] for _ in common] for _ in ends]
        for f, half in zip(ends, halves):
            for e in f:
                half[bisect.bisect_left(common, e)].append(str(f[e]))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*halves)]
        links.append([(ends[0][e], ends[1][e]) for e in common])
        counts.update(links[-1])
        out.append([len(a), len(b), len(common), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*o, sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own)) for o, own in zip(out, links)]


def test_query_equals_a_walk_over_all_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in alignment.op12_alignment(spark, SF).collect()}
    assert [got[d.doc_id] for d in docs] == slow([d.text for d in docs])


@pytest.mark.parametrize("hot", [100_000, 20, 1])
def test_odd_texts_repeated_rows_and_shares_of_hot_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    texts = [*ODD, *ODD[3:8] * 3, "the end of the day"]
    rows = [(i % 20, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_best string, row int")
    got = alignment.with_counts(alignment.aligned(docs))
    assert set(got.columns) == {"doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "n_best", "count_sum"}
    told = [(d, h) for (d, *_), h in zip(rows, slow([r[1] for r in rows]))]
    hashed = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert sorted(map(repr, ((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, hashed(r.groups), r.n_best, r.count_sum)) for r in got.collect()))) == sorted(map(repr, told))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.with_counts(alignment.aligned(docs)).collect() == []
    only = alignment.with_counts(alignment.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).collect()
    assert {(r.n_a, r.n_links, r.groups, r.n_best, r.count_sum) for r in only} == {(0, 0, "", 0, 0)} and len(only) == 2


def test_slices_do_not_show(monkeypatch):
    texts = [f"text {i} of the slice" for i in range(9)] + [None]
    whole = alignment.aligned_texts(texts, alignment.BYTE_LEVEL, alignment.PIECES).to_pylist()
    assert whole == [alignment.aligned_texts([t], alignment.BYTE_LEVEL, alignment.PIECES).to_pylist()[0] for t in texts]
