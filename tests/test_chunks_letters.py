"""Chunks against a loop over all rows, marks of letters against plain recursion."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import chunks, letters


def slow_chunks(sizes, most, count):
    out, held, n = [], 0, 0
    chunk = -1
    for s in sizes:
        if chunk < 0 or held + s > most or n >= count:
            chunk, held, n = chunk + 1, 0, 0
        held, n = held + s, n + 1
        out.append(chunk)
    return out


@pytest.mark.parametrize(("n", "most", "count", "block"), [(400, 50, 7, 16), (400, 50, 7, 7), (257, 9, 5, 32), (100, 10_000, 10, 64), (60, 0, 3, 8), (1, 5, 5, 8), (128, 30, 64, 64)])
def test_chunks_equal_a_loop(spark, n, most, count, block):
    rng = random.Random(n + most)
    sizes = [rng.choice([0, 1, 3, 10, 49, 51, 200]) for _ in range(n)]
    rows = [(i, s if s or i % 2 else None, "x") for i, s in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, size int, extra string")
    got = chunks.chunked(df, F.col("size"), [F.col("id")], most, count, block)
    assert [r.chunk for r in got.orderBy("id").collect()] == slow_chunks(sizes, most, count) and set(got.columns) == {"id", "size", "extra", "chunk"}


def test_no_rows_and_small_blocks(spark):
    df = spark.createDataFrame([], "id int, size int")
    assert chunks.chunked(df, F.col("size"), [F.col("id")], 5, 5).collect() == []
    with pytest.raises(ValueError):
        chunks.chunked(df, F.col("size"), [F.col("id")], 5, 5, block=4)


def slow_distance(a, b):
    @functools.cache
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
            best = min(best, d(i - 2, j - 2) + 1)
        return best

    return d(len(a), len(b))


def test_marks_read_back_both_words_at_the_distance(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcü\U0001f600") for _ in range(rng.randrange(9)))
    pairs = [(word(), word()) for _ in range(300)] + [("Verhältnise", "Verhältnisse"), ("ab" * 40, "ba" * 40), ("x" * 300, "y"), (None, "a"), ("a", None)]
    got = letters.letter_marks(spark.createDataFrame([(i, a, b, "old") for i, (a, b) in enumerate(pairs)], "i int, typed string, expected string, marks string")).orderBy("i").collect()
    for (a, b), r in zip(pairs, got):
        if a is None or b is None:
            assert r.distance is r.close is r.marks is None
            continue
        assert "".join(m.typed for m in r.marks) == a and "".join(m.expected for m in r.marks) == b
        cost = sum({"same": 0, "swap": 1}.get(m.op, max(len(m.typed), len(m.expected))) for m in r.marks)
        assert r.distance == cost == slow_distance(a, b)
        assert r.close == bool(a and b and a != b and cost <= max(2, int(len(b) * 0.4)))


def test_the_gap_goes_to_the_right(spark):
    rows = [("Verhältnise", "Verhältnisse"), ("tpyo", "typo"), ("Haus", "haus"), ("gehte", "ging")]
    got = [[(m.op, m.typed, m.expected) for m in r.marks] for r in letters.letter_marks(spark.createDataFrame(rows, "typed string, expected string").coalesce(1)).collect()]
    assert got[0] == [("same", "Verhältnis", "Verhältnis"), ("missing", "", "s"), ("same", "e", "e")]
    assert got[1] == [("same", "t", "t"), ("swap", "py", "yp"), ("same", "o", "o")] and got[2] == [("wrong", "H", "h"), ("same", "aus", "aus")]
