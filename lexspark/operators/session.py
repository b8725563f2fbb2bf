"""What a learner is asked next: budgets of a day, pending and requested units, the order of new ones, six tiers.

Everything is for all learners at once. Inputs: ``reviews(learner, unit, ts, seq)`` up to now;
``states(learner, unit, pending, due, last, chance)``, one row for each unit a learner has started;
``deck(unit, rank, requested_order, learnable)``; ``requests(learner, unit, asked_at)``, one row for each unit that a
learner has asked for; ``closed(learner, unit)``, units that are known or put off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import replay

# Names of stability bands and the days they end at.
STABILITY_BANDS = (("fresh", 7.0), ("young", 21.0), ("mature", 90.0), ("solid", float("inf")))
TIERS = ("requested", "pending", "overdue", "new", "ahead", "looping")


@dataclass(frozen=True)
class Settings:
    cards_per_day: int = 100
    new_per_day: int | None = 10
    requested_per_day: int = 5
    requested_delay: int = 3
    relearn_spacing: int = 3
    max_asks: int = 4
    gap_minutes: int = 240
    ahead_minutes: int = 1_440


def stability_band(stability: Column) -> Column:
    """The band of a stability in days."""
    found = F.lit(STABILITY_BANDS[-1][0])
    for name, end in STABILITY_BANDS[-2::-1]:
        found = F.when(stability < end, F.lit(name)).otherwise(found)
    return found


def stages(states: DataFrame, marks: DataFrame) -> DataFrame:
    """``(learner, unit, stage)``: known, never or deferred by ``marks(learner, unit, source)``, else learning or the band of ``states``' stability."""
    told = marks.select("learner", "unit", F.when(F.col("source") == "defer", "deferred").when(F.col("source") == "never", "never").otherwise("known").alias("_mark"))
    own = F.when((F.col("state") != "review") | F.col("stability").isNull(), "learning").otherwise(stability_band(F.col("stability")))
    held = states.select("learner", "unit", own.alias("_stage"))
    return held.join(told, ["learner", "unit"], "full").select("learner", "unit", F.coalesce("_mark", "_stage").alias("stage"))


def _day(now: Column) -> Column:
    return F.to_date(now)


def day_budgets(reviews: DataFrame, now: Column, s: Settings = Settings()) -> DataFrame:
    """``(learner, spent, left, new_today, introduced)``.

    The day is charged for every review but the first retry of a unit: one that follows a failed
    review of the unit (``rating`` 1) which itself followed none.
    """
    by_unit = Window.partitionBy("learner", "unit").orderBy("ts", "seq")
    failed = F.col("rating") == 1
    retry = F.coalesce(F.lag(failed).over(by_unit), F.lit(False)) & ~F.coalesce(F.lag(failed, 2).over(by_unit), F.lit(False))
    held = reviews.withColumn("_free", retry).withColumn("_first", F.row_number().over(by_unit) == 1)
    today = F.to_date("ts") == _day(now)
    found = held.groupBy("learner").agg(F.count_if(today & ~F.col("_free")).alias("spent"), F.count_if(today & F.col("_first")).alias("new_today"), F.count_if("_first").alias("introduced"))
    return found.select("learner", "spent", F.greatest(F.lit(s.cards_per_day) - F.col("spent"), F.lit(0)).alias("left"), "new_today", "introduced")


def reviews_after(reviews: DataFrame, marks: DataFrame, at: str) -> DataFrame:
    """``marks(learner, ...)`` with ``since``: reviews of the learner later than the column ``at``, by one running count over both."""
    names = marks.columns
    both = reviews.select("learner", F.col("ts").alias("_ts"), F.lit(1).alias("_n")).unionByName(marks.withColumns({"_ts": F.col(at), "_n": F.lit(0)}), allowMissingColumns=True)
    passed = F.sum("_n").over(Window.partitionBy("learner").orderBy("_ts").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("since", F.sum("_n").over(Window.partitionBy("learner")) - passed).where("_n = 0").select(*names, "since")


def sitting_starts(reviews: DataFrame, now: Column, s: Settings = Settings()) -> DataFrame:
    """``(learner, started)`` of sittings that still go on."""
    return replay.current_sitting(reviews, now, s.gap_minutes).select("learner", F.col("start").alias("started"))


def pending_units(states: DataFrame, reviews: DataFrame, now: Column, s: Settings = Settings(), spaced: bool = True) -> DataFrame:
    """``states`` of pending units that may be shown: after enough other reviews, or at once if left over from an earlier sitting."""
    held = states.where("pending")
    if not spaced:
        return held
    counted = reviews_after(reviews, held, "last").join(sitting_starts(reviews, now, s), "learner", "left")
    return counted.where(F.col("started").isNull() | (F.col("last") < F.col("started")) | (F.col("since") >= s.relearn_spacing)).select(*states.columns)


def requested_units(deck: DataFrame, states: DataFrame, reviews: DataFrame, requests: DataFrame, now: Column, s: Settings = Settings()) -> DataFrame:
    """``(learner, unit, asked_at)``: what a learner asked for and may be shown, in order, as many as the day still has room for. Requests without a time wait for nothing and come first."""
    firsts = reviews.groupBy("learner", "unit").agg(F.min("ts").alias("_first"))
    used = requests.join(firsts, ["learner", "unit"]).where(F.to_date("_first") == _day(now)).groupBy("learner").agg(F.count("*").alias("_used"))
    open_ = requests.join(deck.where("learnable").select("unit"), "unit", "left_semi").join(states, ["learner", "unit"], "left_anti")
    waited = reviews_after(reviews, open_, "asked_at").where(F.col("asked_at").isNull() | (F.col("since") >= s.requested_delay))
    place = F.row_number().over(Window.partitionBy("learner").orderBy("asked_at", "unit"))
    room = F.lit(s.requested_per_day) - F.coalesce("_used", F.lit(0))
    return waited.join(used, "learner", "left").withColumn("_place", place).where(F.col("_place") <= room).select("learner", "unit", "asked_at")


def next_new(deck: DataFrame, started: DataFrame, requests: DataFrame) -> DataFrame:
    """``(learner, unit)``: the first learnable unit that a learner has not started: own requests first, then the deck's order.

    Learners are not crossed with the deck. Its learnable units are numbered, by request order, then
    rank; the numbers of a learner's started units, in order, equal 1, 2, 3, ... up to the first gap.
    """
    numbered = deck.where("learnable").withColumn("_at", F.row_number().over(Window.orderBy(F.col("requested_order").asc_nulls_last(), "rank"))).select("unit", "_at")  # a deck, not a log
    at = started.select("learner", "unit").distinct().join(numbered, "unit").withColumn("_n", F.row_number().over(Window.partitionBy("learner").orderBy("_at")))
    runs = at.groupBy("learner").agg(F.count_if(F.col("_at") == F.col("_n")).alias("_run"))
    everyone = started.select("learner").union(requests.select("learner")).distinct()
    gap = everyone.join(runs, "learner", "left").select("learner", (F.coalesce("_run", F.lit(0)) + 1).alias("_at")).join(numbered, "_at", "left").select("learner", F.col("unit").alias("_general"))
    own = requests.join(numbered, "unit").join(started, ["learner", "unit"], "left_anti").groupBy("learner").agg(F.min_by("unit", F.struct("asked_at", "unit")).alias("_own"))
    return gap.join(own, "learner", "left").select("learner", F.coalesce("_own", "_general").alias("unit")).where("unit is not null")


def untriaged(deck: DataFrame, judged: DataFrame, learners: DataFrame) -> DataFrame:
    """``(learner, n, first)``: how many learnable units a learner has neither judged nor started, and the first by the deck's order."""
    size = deck.where("learnable").agg(F.count("*").alias("_all"))
    seen = judged.select("learner", "unit").distinct().join(deck.where("learnable"), "unit", "left_semi").groupBy("learner").agg(F.count("*").alias("_seen"))
    none = judged.select("learner", "unit", F.lit(None).cast("timestamp").alias("asked_at")).limit(0)
    first = next_new(deck.withColumn("requested_order", F.lit(None).cast("long")), judged.select("learner", "unit").unionByName(learners.select("learner", F.lit(None).cast("long").alias("unit"))), none)
    held = learners.select("learner").distinct().join(seen, "learner", "left").join(first.withColumnRenamed("unit", "first"), "learner", "left").crossJoin(F.broadcast(size))
    return held.select("learner", (F.col("_all") - F.coalesce("_seen", F.lit(0))).alias("n"), "first")


def next_units(deck: DataFrame, states: DataFrame, reviews: DataFrame, requests: DataFrame, closed: DataFrame, now: Column, s: Settings = Settings()) -> DataFrame:
    """``(learner, tier, unit)``: one unit for each learner who has anything left to be asked.

    Tiers: requested; pending and spaced; overdue; new within the budget; due soon; pending at any
    spacing. No unit that was among the last ``relearn_spacing`` of the sitting comes back (but
    for requested, new and looping ones), none is asked more than ``max_asks`` times in a sitting, and the
    unit shown last only comes where its tier has no other one if requested or overdue, never if pending or ahead; looping units go by their chance alone.
    """
    states = states.join(closed, ["learner", "unit"], "left_anti")
    sitting = reviews.join(sitting_starts(reviews, now, s), "learner").where("ts >= started")
    back = F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("ts"), F.desc("seq")))
    in_sitting = sitting.withColumn("_back", back).groupBy("learner", "unit").agg(F.count("*").alias("asks"), F.min("_back").alias("back"))
    last = reviews.groupBy("learner").agg(F.max_by("unit", F.struct("ts", "seq")).alias("last_unit"))
    keys = lambda tier, df, first, second: df.select("learner", "unit", F.lit(tier).alias("tier"), first.cast("double").alias("k1"), second.cast("double").alias("k2"))
    rank = deck.select("unit", "rank")
    due = states.join(rank, "unit")
    until = F.timestamp_micros(F.unix_micros(now) + F.lit(s.ahead_minutes * 60_000_000))
    budgets = day_budgets(reviews, now, s)
    new = next_new(deck, states.select("learner", "unit").unionByName(closed.select("learner", "unit")), requests).join(budgets, "learner", "left")
    room = F.coalesce("left", F.lit(s.cards_per_day)) > 0
    if s.new_per_day is not None:
        room = room & (F.coalesce("new_today", F.lit(0)) < s.new_per_day)
    wanted = requested_units(deck, states, reviews, requests.join(closed, ["learner", "unit"], "left_anti"), now, s)
    found = [
        keys(0, wanted, F.unix_micros("asked_at"), F.col("unit")),
        keys(1, pending_units(states, reviews, now, s).join(rank, "unit"), F.col("chance"), F.col("rank")),
        keys(2, due.where(F.col("due") <= now), F.col("chance"), F.col("rank")),
        keys(3, new.where(room), F.lit(0), F.lit(0)),
        keys(4, due.where(F.col("due") <= until), F.col("chance"), F.col("rank")),
        keys(5, states.where("pending").join(rank, "unit"), F.col("chance"), F.col("rank")),
    ]
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    held = every.join(in_sitting, ["learner", "unit"], "left").join(last, "learner", "left")
    shown_last = F.coalesce(F.col("unit") == F.col("last_unit"), F.lit(False))
    tired = (F.coalesce("asks", F.lit(0)) >= s.max_asks) & (F.col("tier") != 3) if s.max_asks > 0 else F.lit(False)
    near = (F.coalesce("back", F.lit(1 << 30)) <= s.relearn_spacing) & F.col("tier").isin(1, 2, 4)
    held = held.where(~tired & ~near & ~(shown_last & F.col("tier").isin(1, 4)))
    best = held.groupBy("learner").agg(F.min(F.struct("tier", (shown_last & F.col("tier").isin(0, 2)).alias("again"), "k1", "k2", "unit")).alias("b"))
    return best.select("learner", F.element_at(F.array(*[F.lit(x) for x in TIERS]), F.col("b.tier") + 1).alias("tier"), "b.unit")
