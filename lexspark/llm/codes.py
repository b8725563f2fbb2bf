"""Compression of vectors to short codes: product quantisation in integers, with equal-average search.

Every vector is cut into parts of equal length and each part is named by the nearest entry of its
position's codebook. The nearest entry is found by sums: a codebook is sorted by the sum of its
entries' components, the search starts where the part's own sum stands and goes outward, nearer sums
first. Cauchy-Schwarz says that the squared gap of two sums, divided by the dimension, is a lower
bound of the squared distance, so a part is settled as soon as its next gap strictly exceeds that bound for its best
distance; entries left out can neither be nearer nor tie.

Rows are only ever mapped. What a round of learning sends is one row for each task, position and
entry: how many parts chose the entry, and their sums, which no group of equal vectors makes longer.
Codebooks (positions times entries times components, all of them parameters) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import stored, table

#: Components are multiplied by this before they are rounded down; parts of a vector, entries of a codebook, rounds of learning.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Up to this size of a component, squared distances and gaps of parts of up to 1,024 components fit 64 bits; larger ones are counted in whole numbers of Python.
PLAIN = 1 << 20
#: Labels whose error sums are broadcast; beyond that they are joined by a shuffle.
BROADCAST_LABELS = 50_000
Books = list[list[list[int]]]  # by position, entry, component


def usable(vector: Column, length: int | None = None) -> Column:
    """Whether a vector is there, has no null or non-finite component, and has ``length`` components where that is given."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & sound & (F.lit(True) if length is None else F.size(vector) == length)


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exact for every finite x: int64 if all results are small, else whole numbers of Python."""
    scaled = np.floor(values.astype(np.float64) * scale) if np.abs(values).max(initial=0) < PLAIN else None
    if scaled is not None and np.abs(scaled).max(initial=0) <= PLAIN:
        return scaled.astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.astype(np.float64).ravel().tolist()]
    return np.array([*exact, None], dtype=object)[:-1].reshape(values.shape)


class Codebook:
    """Entries of one position, sorted by the sum of their components for the search."""

    def __init__(self, entries: list[list[int]]) -> None:
        self.entries, self.dims = entries, len(entries[0])
        self.order = sorted(range(len(entries)), key=lambda i: (sum(entries[i]), i))
        self.sums = [sum(entries[i]) for i in self.order]
        self.small = max((abs(x) for e in entries for x in e), default=0) <= PLAIN and self.dims <= 1024

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row; ties go to the lower entry."""
        if self.small and parts.dtype != object:
            return self._nearest_of_all(parts)
        found = [self._nearest_of_one([int(x) for x in p]) for p in parts.tolist()]
        return np.array([f[0] for f in found], np.int64), np.array([*[f[1] for f in found], None], dtype=object)[:-1]

    def _nearest_of_all(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, far = len(parts), len(self.sums), np.iinfo(np.int64).max
        book, order = np.array(self.entries, np.int64), np.array(self.order, np.int64)
        # a place outside the codebook is as far as can be
        sums = np.array([0, *self.sums, 0], np.int64)
        at_end = np.array([True, *[False] * k, True])
        mean = parts.sum(axis=1)
        right = np.searchsorted(sums[1:-1], mean) + 1
        left = right - 1
        best, entry, alive = np.full(n, far), np.full(n, k), np.arange(n)
        while len(alive):
            below, above = left[alive], right[alive]
            gap_below = np.where(at_end[below], far, mean[alive] - sums[below])
            gap_above = np.where(at_end[above], far, sums[above] - mean[alive])
            down = gap_below <= gap_above
            gap = np.minimum(gap_below, gap_above)
            # gap^2 / dims > best ends a search; nothing is left where both sides ended
            going = (gap < far) & ((best[alive] == far) | (np.where(gap < far, gap, 0) ** 2 <= np.minimum(best[alive], far // self.dims) * self.dims))
            alive, down = alive[going], down[going]
            if not len(alive):
                break
            tried = order[np.where(down, left[alive], right[alive]) - 1]
            distance = np.square(parts[alive] - book[tried]).sum(axis=1)
            better = (distance < best[alive]) | ((distance == best[alive]) & (tried < entry[alive]))
            won = alive[better]
            best[won], entry[won] = distance[better], tried[better]
            left[alive[down]] -= 1
            right[alive[~down]] += 1
        return entry, best

    def _nearest_of_one(self, part: list[int]) -> tuple[int, int]:
        own, k = sum(part), len(self.sums)
        right = next((i for i, s in enumerate(self.sums) if s >= own), k)
        left, best = right - 1, None
        while left >= 0 or right < k:
            down = right >= k or (left >= 0 and own - self.sums[left] <= self.sums[right] - own)
            at = left if down else right
            if best is not None and (own - self.sums[at]) ** 2 > self.dims * best[0]:
                break
            entry = self.order[at]
            told = (sum((a - b) ** 2 for a, b in zip(part, self.entries[entry])), entry)
            best = told if best is None else min(best, told)
            left, right = (left - 1, right) if down else (left, right + 1)
        return best[1], best[0]


def _matrix(vectors: pa.ListArray, length: int, scale: int) -> np.ndarray:
    return whole(np.asarray(vectors.flatten()).reshape(-1, length), scale)


def _chosen(vectors: DataFrame, books: Books, length: int, scale: int) -> DataFrame:
    """``(part, entry, n, sums)``, one row a task, position and entry that is chosen there; sums in decimal digits."""
    width = length // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        counts = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((len(books), len(books[0]), width), dtype=object)
        for b in batches:
            rows = _matrix(b.column(0), length, scale)
            for p, book in enumerate(searched):
                own = rows[:, p * width : (p + 1) * width]
                entry, _ = book.nearest(own)
                counts[p] += np.bincount(entry, minlength=len(books[0]))
                for e in np.unique(entry).tolist():
                    sums[p, e] += own[entry == e].sum(axis=0).astype(object)
        at = np.argwhere(counts)
        texts = [[str(x) for x in sums[p, e]] for p, e in at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[counts > 0], pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"]
        )

    return vectors.mapInArrow(run, "part int, entry int, n long, sums array<string>")


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of one position and entry, summed in whole numbers of any size."""
    total = [0] * len(rows["sums"][0])
    for sums in rows["sums"]:
        total = [a + int(b.as_py()) for a, b in zip(total, sums)]
    n = sum(rows["n"].to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()), "means": pa.array([[str(x // n) for x in total]], pa.list_(pa.string()))})


def learnt_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """Codebooks of ``vectors``, one for each position of a part: entries are lists of whole numbers.

    They start from the vectors of the smallest ids, ascending (rows of one id by their vectors; null
    ids never start an entry), fewer than ``entries`` if there are fewer rows. Each round assigns all parts
    to their nearest entries and moves every entry to the floor of its parts' means; an entry that no part
    chose stays. Vectors must be usable and as long as the first; others take no part. No usable
    vector whose length is a multiple of ``parts``: no codebooks.
    """
    sound = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    first = sound.where("id is not null").orderBy("id", "v").select("v").limit(entries).collect()
    if not first:
        return []
    length = len(first[0].v)
    starts = [whole(np.array(r.v, np.float64), scale).tolist() for r in first if len(r.v) == length]
    width = length // parts
    books = [[[int(x) for x in s[p * width : (p + 1) * width]] for s in starts] for p in range(parts)]
    rows = sound.where(F.size("v") == length).select("v")
    for _ in range(rounds):
        moved = _chosen(rows, books, length, scale).groupBy("part", "entry").applyInArrow(_merged, "part int, entry int, means array<string>")
        for r in moved.collect():  # as many rows as the codebooks have entries, at most
            books[r.part][r.entry] = [int(x) for x in r.means]
    return books


def encoded(vectors: DataFrame, books: Books, vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors`` without their vectors, with ``code`` and ``error``.

    ``code`` has two lower-case hex digits for each part, ``error`` is the squared distance of the
    vector and its entries, null where a long cannot hold it. Vectors that are null, hold null or
    non-finite components or have another length than the codebooks are left out. Columns named
    ``code`` or ``error`` are replaced, others stay. No codebooks or no rows: no rows.
    """
    names = [c for c in vectors.columns if c not in {vector_col, "code", "error"}]
    schema = vectors.select(*names, F.lit("").alias("code"), F.lit(None).cast("long").alias("error")).schema
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    width, length = len(books[0][0]), len(books) * len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        for b in batches:
            rows = _matrix(b.column(len(names)), length, scale)
            digits, error = np.empty((len(rows), len(books)), np.uint8), np.zeros(len(rows), dtype=object)
            for p, book in enumerate(searched):
                digits[:, p], distance = book.nearest(rows[:, p * width : (p + 1) * width])
                error += distance.astype(object)
            codes = [x.tobytes().hex() for x in digits]
            errors = [int(e) if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    return vectors.where(usable(F.col(vector_col), length)).select(*names, vector_col).mapInArrow(run, schema)


def decoded(codes: DataFrame, books: Books, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``: the entries that ``code`` names, divided by ``scale``; null for a null code."""
    held = F.from_json(F.lit(json.dumps(books)), "array<array<array<double>>>")
    entry = lambda p: F.conv(F.substr(F.col("code"), 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    read = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.transform(F.get(F.get(held, p), entry(p)), lambda x: x / scale)))
    return codes.drop("vector").withColumn("vector", F.when(F.col("code").isNotNull(), read))


def with_label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows with the same label, nulls together.

    The sums are combined before they are shuffled, so a label of a third of all rows is a few rows;
    they come back by a broadcast if there are few (counted before), else by a join that AQE splits.
    Null where one of the errors, or the sum, does not fit a long.
    """
    sums = codes.groupBy(F.col(label_col).alias("_label")).agg(F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long").alias("label_error"))
    sums = stored(sums, "label_errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.drop("label_error").join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")


def codebooks_hash(books: Books) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, with commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every usable row of ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    books = learnt_codebooks(vectors)
    codes = stored(encoded(vectors.select("vec_id", "label", "embedding"), books), "codes")
    return with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """All entries are tried for every part here; the rounds are written out."""
    nearest = "SELECT p.nr, p.part, arg_min(b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + b.entry) AS entry FROM p JOIN b{0} b ON p.part = b.part GROUP BY ALL"
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS nr, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT nr, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x FROM v, range(8) AS r(part))",
        "b0 AS MATERIALIZED (SELECT part, nr - 1 AS entry, x FROM p WHERE nr <= 16)",
    ]
    for i in range(ROUNDS):
        steps += [
            f"a{i} AS MATERIALIZED ({nearest.format(i)})",
            f"u{i} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY place) AS x FROM (SELECT a.part, a.entry, place, CAST(floor(sum(p.x[place]) / count(*)) AS BIGINT) AS m FROM p JOIN a{i} a ON p.nr = a.nr AND p.part = a.part, (SELECT DISTINCT unnest(range(1, len(x) + 1)) AS place FROM p) GROUP BY ALL) GROUP BY ALL)",
            f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{i} b LEFT JOIN u{i} u ON b.part = u.part AND b.entry = u.entry)",
        ]
    steps += [
        f"a{ROUNDS} AS MATERIALIZED ({nearest.format(ROUNDS)})",
        f"e AS (SELECT a.nr, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS BIGINT) AS error FROM a{ROUNDS} a JOIN p ON p.nr = a.nr AND p.part = a.part JOIN b{ROUNDS} b ON b.part = a.part AND b.entry = a.entry GROUP BY a.nr)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (nr), h"


SQL = _sql()
