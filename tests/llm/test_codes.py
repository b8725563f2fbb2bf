"""Vector codes against a search of all entries in whole numbers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def slow_codes(rows, entries=16, rounds=6):
    floor = lambda x: math.floor(Fraction(x) * 4096)
    kept = [(i, v, label) for i, v, label in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted([(i, v) for i, v, _ in kept if i is not None and len(v) % 8 == 0])[:entries]
    kept = [(i, [floor(x) for x in v], label) for i, v, label in kept if first and len(v) == len(first[0][1])]
    if not first:
        return {}, ""
    w = len(first[0][1]) // 8
    books = [[[floor(x) for x in v[p * w : p * w + w]] for _, v in first if len(v) == 8 * w] for p in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((distance(v[p * w : p * w + w], e), j) for j, e in enumerate(books[p])) for p in range(8)] for _, v, _ in kept]
    for _ in range(rounds):
        chosen = assign()
        for p in range(8):
            for j in range(len(books[p])):
                own = [v[p * w : p * w + w] for (_, v, _), c in zip(kept, chosen) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    out, sums = [], {}
    for (i, _, label), c in zip(kept, assign()):
        out.append((i, "".join(f"{j:02x}" for _, j in c), sum(d for d, _ in c), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    fit = lambda x: x if x < 1 << 63 else None
    told = sorted(((i, c, fit(e), fit(sums[label]) if all(x[2] < 1 << 63 for x in out if x[3] == label) else None) for i, c, e, label in out), key=repr)
    return told, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def run(spark, rows):
    vectors = spark.createDataFrame([(i, v, label, "old") for i, v, label in rows], SCHEMA)
    books = codes.learnt_codebooks(vectors)
    got = codes.with_label_errors(codes.encoded(vectors, books)).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr), codes.codebooks_hash(books), books


def cases():
    rng = random.Random(4)
    plain = [(i, [rng.gauss(0, 0.2) for _ in range(16)], i % 3) for i in range(90)]
    odd = [(200, None, 0), (201, [0.1] * 15 + [None], 0), (202, [math.nan] * 16, 1), (203, [math.inf] * 16, 1), (204, [], 2), (205, [0.5] * 24, 2), (None, [0.3] * 16, None), (206, [0.2] * 16, None)]
    same = [(300 + i, [0.25, -0.25] * 8, 7) for i in range(40)] + [(300, [0.25, -0.25] * 8, 7)] * 3
    huge = [(400, [1e300, -1e300] * 8, 9), (401, [1e300] * 16, 9), (402, [3e38, 1e-300] * 8, 8), (403, [2.0**52 + 0.5, -7.3] * 8, 8), (404, [-1e-320] * 16, 6)]
    few = [(5, [1.0] * 8, 0), (3, [0.0] * 8, 0)]
    tied = [(i, [float(i % 2)] * 8, 0) for i in range(20)] + [(30, [0.5] * 8, 0)]
    return {"plain": plain, "odd": plain + odd, "same": same + plain, "huge first": [(i - 500, v, x) for i, v, x in huge] + plain, "huge": plain + huge, "few": few, "tied": tied}


@pytest.mark.parametrize("name", list(cases()))
def test_codes_equal_a_search_of_all_entries(spark, name):
    rows = cases()[name]
    told, digest = slow_codes(rows)
    got, own, books = run(spark, rows)
    assert (got, own) == (told, digest)


def test_no_vectors_give_no_rows(spark):
    got, _, books = run(spark, [])
    assert got == [] and books == []
    assert run(spark, [(1, None, 0), (2, [0.1] * 7, 0)])[0] == []


def test_search_goes_outward_from_the_sum():
    rng = np.random.default_rng(1)
    entries = rng.integers(-300, 300, (40, 8))
    parts = np.concatenate([rng.integers(-400, 400, (500, 8)), entries, entries[:, ::-1]])
    book = codes.Codebook(entries.tolist())
    entry, best = book.nearest(parts)
    all_of = np.square(parts[:, None] - entries[None]).sum(2)
    assert (entry == all_of.argmin(1)).all() and (best == all_of.min(1)).all()
    again = book.nearest(parts.astype(object))
    assert (again[0] == entry).all() and (again[1] == best).all()


def test_decoded_vectors_are_the_entries(spark):
    rows = cases()["plain"]
    vectors = spark.createDataFrame([(i, v, label, "old") for i, v, label in rows], SCHEMA)
    books = codes.learnt_codebooks(vectors)
    held = codes.decoded(codes.encoded(vectors, books), books).join(vectors.select("vec_id", "embedding"), "vec_id")
    for r in held.collect():
        own = [math.floor(x * 4096) for x in r.embedding]
        assert sum((a - round(b * 4096)) ** 2 for a, b in zip(own, r.vector)) == r.error
    assert held.where(F.size("vector") != 16).count() == 0
