"""The memory model of reviews: retrievability, stability, difficulty and intervals, as Column expressions.

Ratings are 1 (again) to 4 (easy). One learning step and one relearning step of ``STEP_MINUTES``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published default weights of the 21-parameter model, version 6.
WEIGHTS = (
    0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796,
    1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542,
)
RETENTION, MOST_DAYS, STEP_MINUTES, LEAST = 0.9, 36_500, 10, 0.001
RATINGS = {"again": 1, "hard": 2, "good": 3, "easy": 4}


def curve(w: Sequence[float] = WEIGHTS) -> tuple[float, float]:
    """Decay and factor of the forgetting curve."""
    decay = -w[20]
    return decay, 0.9 ** (1 / decay) - 1


def whole_days(start: Column, end: Column) -> Column:
    """Whole spans of 24 hours between two timestamps, 0 at least."""
    return F.greatest(F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)), F.lit(0)).cast("double")


def retrievability(stability: Column, days: Column, w: Sequence[float] = WEIGHTS) -> Column:
    decay, factor = curve(w)
    return F.pow(1 + F.lit(factor) * days / stability, F.lit(decay))


def _clamp(d: Column) -> Column:
    return F.least(F.greatest(d, F.lit(1.0)), F.lit(10.0))


def first_stability(r: Column, w: Sequence[float] = WEIGHTS) -> Column:
    return F.greatest(F.element_at(F.array(*[F.lit(float(x)) for x in w[:4]]), r.cast("int")), F.lit(LEAST))


def first_difficulty(r: Column, w: Sequence[float] = WEIGHTS) -> Column:
    return F.lit(w[4]) - F.exp(F.lit(w[5]) * (r - 1)) + 1


def next_difficulty(d: Column, r: Column, w: Sequence[float] = WEIGHTS) -> Column:
    easy = first_difficulty(F.lit(4.0), w)
    return _clamp(F.lit(w[7]) * easy + (1 - w[7]) * (d + (10 - d) * (F.lit(-w[6]) * (r - 3)) / 9))


def next_stability(s: Column, d: Column, r: Column, days: Column, w: Sequence[float] = WEIGHTS) -> Column:
    """Stability after a review; ``d`` is the difficulty before it."""
    growth = F.exp(F.lit(w[17]) * (r - 3 + w[18])) * F.pow(s, F.lit(-w[19]))
    same_day = s * F.when(r == 1, growth).otherwise(F.greatest(growth, F.lit(1.0)))
    left = 1 - retrievability(s, days, w)
    forget = F.lit(w[11]) * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp(left * w[14])
    forget = F.least(forget, s / F.exp(F.lit(w[17] * w[18])))
    bonus = F.when(r == 2, F.lit(w[15])).when(r == 4, F.lit(w[16])).otherwise(F.lit(1.0))
    recall = s * (1 + F.exp(F.lit(w[8])) * (11 - d) * F.pow(s, F.lit(-w[9])) * (F.exp(left * w[10]) - 1) * bonus)
    return F.greatest(F.when(days < 1, same_day).when(r == 1, forget).otherwise(recall), F.lit(LEAST))


def interval_days(s: Column, retention: float = RETENTION, most: int = MOST_DAYS, w: Sequence[float] = WEIGHTS) -> Column:
    decay, factor = curve(w)
    return F.least(F.greatest(F.bround(s / factor * (retention ** (1 / decay) - 1)), F.lit(1.0)), F.lit(float(most)))


def initial_state() -> Column:
    return F.struct(
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("double").alias("stability"), F.lit(None).cast("double").alias("difficulty"),
        F.lit(None).cast("timestamp").alias("last"), F.lit(None).cast("timestamp").alias("due"), F.lit(0).alias("reps"), F.lit(0).alias("lapses"),
    )


def reviewed(a: Column, x: Column, w: Sequence[float] = WEIGHTS) -> Column:
    """State ``a`` after review ``x(ts, rating)``. learning -> review on good or easy; review -> relearning on again."""
    r, ts = x["rating"].cast("double"), x["ts"]
    new = a["state"].isNull()
    days = F.when(new, F.lit(0.0)).otherwise(whole_days(a["last"], ts))
    s = F.when(new, first_stability(r, w)).otherwise(next_stability(a["stability"], a["difficulty"], r, days, w))
    d = F.when(new, _clamp(first_difficulty(r, w))).otherwise(next_difficulty(a["difficulty"], r, w))
    in_review = F.coalesce(a["state"] == "review", F.lit(False))
    state = F.when(r >= 3, "review").when(in_review & (r == 2), "review").when(in_review, "relearning").otherwise(F.coalesce(a["state"], F.lit("learning")))
    minutes = F.when(state == "review", interval_days(s, w=w) * 1440).when(r == 2, F.lit(STEP_MINUTES * 1.5)).otherwise(F.lit(float(STEP_MINUTES)))
    due = F.timestamp_micros(F.unix_micros(ts) + (minutes * 60_000_000).cast("long"))
    return F.struct(
        state.alias("state"), s.alias("stability"), d.alias("difficulty"), ts.alias("last"), due.alias("due"),
        (a["reps"] + 1).alias("reps"), (a["lapses"] + (in_review & (r == 1)).cast("int")).alias("lapses"),
    )
