"""Marks of a near spelling, letter by letter: an alignment of what was typed and what was wanted, with swapped neighbours as one edit.

The table of distances is filled for all pairs of a batch at once, a cell at a time; reading it back is a walk along one pair's letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the tables that a task holds at once; a longer pair has a table of its own.
CELLS = 500_000
MARKS = "array<struct<op:string,typed:string,expected:string>>"
_MARKS = pa.list_(pa.struct([(c, pa.string()) for c in ("op", "typed", "expected")]))


def _codes(words: list[str], width: int, none: int) -> np.ndarray:
    out = np.full((len(words), width), none, np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def distances(typed: list[str], expected: list[str]) -> np.ndarray:
    """Tables of all pairs: entry (i, j) is the distance of the first i letters typed and the first j wanted."""
    n, la, lb = len(typed), max(map(len, typed), default=0), max(map(len, expected), default=0)
    a, b = _codes(typed, la, -1), _codes(expected, lb, -2)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    d = np.zeros((la + 1, lb + 1, n), np.int32)  # pairs last: a step of all pairs reads and writes neighbours
    d[:, 0], d[0] = np.arange(la + 1)[:, None], np.arange(lb + 1)[:, None]
    for i in range(1, la + 1):
        for j in range(1, lb + 1):
            best = np.minimum(np.minimum(d[i - 1, j], d[i, j - 1]) + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1:
                swap = (a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1]) & (a[i - 1] != a[i - 2])
                if swap.any():
                    best = np.where(swap, np.minimum(best, d[i - 2, j - 2] + 1), best)
            d[i, j] = best
    return np.ascontiguousarray(d.transpose(2, 0, 1))


def marks(a: str, b: str, d: list[list[int]]) -> list[list[str]]:
    """Segments from left to right; of equal alignments the one whose gap is further right, kinds in a row as one segment but for swaps."""
    out: list[list[str]] = []
    i, j = len(a), len(b)
    while i or j:
        here = d[i][j]
        if i and d[i - 1][j] + 1 == here:
            op, x, y = "extra", 1, 0
        elif j and d[i][j - 1] + 1 == here:
            op, x, y = "missing", 0, 1
        elif a[i - 1] == b[j - 1] and d[i - 1][j - 1] == here:
            op, x, y = "same", 1, 1
        elif i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and d[i - 2][j - 2] + 1 == here:
            op, x, y = "swap", 2, 2
        else:
            op, x, y = "wrong", 1, 1
        left, right = a[i - x : i], b[j - y : j]
        if out and out[-1][0] == op != "swap":
            out[-1][1:] = [left + out[-1][1], right + out[-1][2]]
        else:
            out.append([op, left, right])
        i, j = i - x, j - y
    return out[::-1]


def _column(found: list[list[list[str]] | None]) -> pa.Array:
    """Lists of marks as one column, from flat columns of their fields."""
    flat = [m for marked in found if marked for m in marked]
    fields = [pa.array([m[k] for m in flat], pa.string()) for k in range(3)]
    ends = np.cumsum([0, *[len(marked or ()) for marked in found]])
    starts = pa.array(ends, pa.int32(), mask=np.array([*[marked is None for marked in found], False]))
    return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(fields, fields=list(_MARKS.value_type)))


def letter_marks(pairs: DataFrame, typed: str = "typed", expected: str = "expected") -> DataFrame:
    """``pairs`` with ``distance``, ``close`` (misspelt, not another word: two edits or four tenths of the letters wanted) and ``marks``.

    Marks are ``(op, typed, expected)`` with op same, missing, extra, wrong or swap. A null on either side gives nulls; empty
    and equal words are never close. Columns of these names are replaced. Repeated pairs are aligned each.
    """
    names = [c for c in pairs.columns if c not in {"distance", "close", "marks"}]
    schema = pairs.select(*names, F.lit(None).cast("int").alias("distance"), F.lit(None).cast("boolean").alias("close"), F.lit(None).cast(MARKS).alias("marks")).schema
    at = [names.index(typed), names.index(expected)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in at)
            told: list[tuple] = [(None, None, None)] * len(a)
            whole = sorted((i for i in range(len(a)) if a[i] is not None and b[i] is not None), key=lambda i: (len(a[i]), len(b[i])))
            start = 0
            while start < len(whole):
                stop, la, lb = start, 0, 0
                while stop < len(whole):
                    na, nb = max(la, len(a[whole[stop]])), max(lb, len(b[whole[stop]]))
                    if stop > start and (stop - start + 1) * (na + 1) * (nb + 1) > CELLS:
                        break
                    la, lb, stop = na, nb, stop + 1
                part = whole[start:stop]
                tables = distances([a[i] for i in part], [b[i] for i in part])
                for i, table in zip(part, tables):
                    x, y = a[i], b[i]
                    d = table[: len(x) + 1, : len(y) + 1].tolist()  # cells of a list are read several times faster one by one
                    far = d[len(x)][len(y)]
                    told[i] = (far, bool(x and y and x != y and far <= max(2, len(y) * 4 // 10)), marks(x, y, d))
                start = stop
            cols = [*[pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int32(), pa.bool_()))], _column([t[2] for t in told])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*names, "distance", "close", "marks"])

    return pairs.select(*names).mapInArrow(run, schema)
