"""Association measures over counts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _term(observed: Column, expected: Column) -> Column:
    return F.when((observed > 0) & (expected > 0), observed * F.log(observed / expected)).otherwise(F.lit(0.0))


def log_likelihood(pair: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's G2 of the 2x2 table of a and b among n; 0 where a cell would be negative or n is not positive."""
    pair, a, b, n = (x.cast("double") for x in (pair, a, b, n))
    o12, o21, o22 = a - pair, b - pair, n - a - b + pair
    total = _term(pair, a * b / n) + _term(o12, a * (n - b) / n) + _term(o21, (n - a) * b / n) + _term(o22, (n - a) * (n - b) / n)
    return F.when((n > 0) & (F.least(pair, o12, o21, o22) >= 0), 2 * total).otherwise(F.lit(0.0))


def lift(pair: Column, a: Column, b: Column, n: Column) -> Column:
    """How much likelier the pair is than chance; 0 for an empty marginal."""
    pair, a, b, n = (x.cast("double") for x in (pair, a, b, n))
    return F.when((a != 0) & (b != 0) & (n != 0), (pair / n) / ((a / n) * (b / n))).otherwise(F.lit(0.0))


def pmi(pair: Column, left: Column, right: Column, total: Column) -> Column:
    """Pointwise mutual information in bits; 0 where any count is not positive."""
    pair, left, right, total = (x.cast("double") for x in (pair, left, right, total))
    counted = (pair > 0) & (left > 0) & (right > 0) & (total > 0)
    return F.when(counted, F.log2((pair / total) / ((left / total) * (right / total)))).otherwise(F.lit(0.0))
