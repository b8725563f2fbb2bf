"""The review log as a stream: entries once, and the memory model's state kept for each learner's units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexspark.functions import memory as M

LOG = "learner long, seq long, ts timestamp, type string, unit long, rating int"
STATE = "learner long, unit long, state string, stability double, difficulty double, last timestamp, due timestamp, reps int, lapses int"


def log_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of JSON entries as a stream; lines that are no entries are left out."""
    raw = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).option("mode", "DROPMALFORMED").json(path)
    return raw.where("learner is not null and ts is not null")


def once(log: DataFrame, late: str = "30 days") -> DataFrame:
    """Entries of several devices, each once, as long as its copies come within ``late``."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["learner", "type", "unit", "ts"])


def asks_by_window(log: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Reviews and lapses in each window of time, closed when the watermark has passed it."""
    held = log.where("type = 'review'").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return held.agg(F.count("*").alias("asks"), F.count_if(F.col("rating") == 1).alias("again")).select("w.start", "w.end", "asks", "again")


def sitting_stream(log: DataFrame, gap: str = "60 minutes", late: str = "1 day") -> DataFrame:
    """Sittings of each learner: entries no further apart than the gap."""
    held = log.withWatermark("ts", late).groupBy("learner", F.session_window("ts", gap).alias("w"))
    return held.agg(F.count("*").alias("asks")).select("learner", "w.start", "w.end", "asks")


def _review(s: dict, ts: pd.Timestamp, r: int) -> dict:
    """One step of the model on plain values, for the state store; the batch form is ``memory.reviewed``."""
    import math

    w = M.WEIGHTS
    decay, factor = M.curve()
    clamp = lambda d: min(max(d, 1.0), 10.0)
    first = lambda x: w[4] - math.exp(w[5] * (x - 1)) + 1
    if s["state"] is None:
        stability, difficulty = max(w[r - 1], M.LEAST), clamp(first(r))
    else:
        days = float(max((ts - s["last"]) // pd.Timedelta(days=1), 0))
        old, d = s["stability"], s["difficulty"]
        left = 1 - (1 + factor * days / old) ** decay
        if days < 1:
            growth = math.exp(w[17] * (r - 3 + w[18])) * old ** -w[19]
            stability = old * (growth if r == 1 else max(growth, 1.0))
        elif r == 1:
            stability = min(w[11] * d ** -w[12] * ((old + 1) ** w[13] - 1) * math.exp(left * w[14]), old / math.exp(w[17] * w[18]))
        else:
            bonus = {2: w[15], 4: w[16]}.get(r, 1.0)
            stability = old * (1 + math.exp(w[8]) * (11 - d) * old ** -w[9] * (math.exp(left * w[10]) - 1) * bonus)
        stability = max(stability, M.LEAST)
        difficulty = clamp(w[7] * first(4) + (1 - w[7]) * (d + (10 - d) * (-w[6] * (r - 3)) / 9))
    was_review = s["state"] == "review"
    state = "review" if r >= 3 or (was_review and r == 2) else "relearning" if was_review else s["state"] or "learning"
    days_off = min(max(float(round(stability / factor * (M.RETENTION ** (1 / decay) - 1))), 1.0), float(M.MOST_DAYS))
    wait = pd.Timedelta(days=days_off) if state == "review" else pd.Timedelta(minutes=M.STEP_MINUTES * (1.5 if r == 2 else 1))
    return {"state": state, "stability": stability, "difficulty": difficulty, "last": ts, "due": ts + wait, "reps": s["reps"] + 1, "lapses": s["lapses"] + int(was_review and r == 1)}


def state_stream(reviews: DataFrame) -> DataFrame:
    """The state of each unit after each batch of its reviews, one row for each unit that the batch has.

    Reviews come in order within a unit, or within one batch; one that comes later than that is
    folded in as of now. The batch form over the whole log is exact for any order.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        fields = ("state", "stability", "difficulty", "last", "due", "reps", "lapses")
        s = dict(zip(fields, held.get)) if held.exists else dict(zip(fields, (None, None, None, None, None, 0, 0)))
        for _, row in pd.concat(list(frames)).sort_values(["ts", "seq"]).iterrows():
            s = _review(s, pd.Timestamp(row.ts), int(row.rating))
        plain = {**s, "last": s["last"].to_pydatetime(), "due": s["due"].to_pydatetime()}
        held.update(tuple(plain[f] for f in fields))
        yield pd.DataFrame([{"learner": key[0], "unit": key[1], **s}])

    kept = "state string, stability double, difficulty double, last timestamp, due timestamp, reps int, lapses int"
    return reviews.where("rating is not null and unit is not null").groupBy("learner", "unit").applyInPandasWithState(fold, STATE, kept, "update", GroupStateTimeout.NoTimeout)
