"""The review log: merging, state by unit, sittings, what is due, and a learner's figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import memory as M

MATURE_DAYS, GAP_MINUTES, BAND = 21, 60, 500


def merged_logs(logs: DataFrame, keys: list[str], priority: Column, order: list[Column]) -> DataFrame:
    """One row an entry from the logs of several devices; the first log wins, then the order."""
    names = [c for c in logs.columns if c not in keys]
    first = F.min(F.struct(priority.alias("_p"), *[o.alias(f"_o{i}") for i, o in enumerate(order)], *names)).alias("r")
    return logs.groupBy(*keys).agg(first).select(*keys, *[F.col(f"r.{n}").alias(n) for n in names])


def since_reset(log: DataFrame) -> DataFrame:
    """Entries after a learner's last reset."""
    at = F.max(F.when(F.col("type") == "reset", F.struct("ts", "seq"))).over(Window.partitionBy("learner"))
    return log.withColumn("_reset", at).where("_reset is null or struct(ts, seq) > _reset").drop("_reset")


def unit_states(reviews: DataFrame) -> DataFrame:
    """``(learner, unit, state, stability, difficulty, last, due, reps, lapses)``: the model folded over each unit's reviews in order.

    A fold reads the reviews of one learner's one unit, in the JVM; there is no shuffle but the grouping.
    """
    entries = F.array_sort(F.collect_list(F.struct("ts", "seq", "rating")))
    folded = reviews.groupBy("learner", "unit").agg(entries.alias("e")).select("learner", "unit", F.aggregate("e", M.initial_state(), lambda a, x: M.reviewed(a, x)).alias("s"))
    return folded.select("learner", "unit", "s.*")


def due_units(states: DataFrame, now: Column, horizon_hours: int = 0) -> DataFrame:
    """Units due by ``now`` and the horizon, the likeliest forgotten first, with retrievability to four places."""
    until = F.timestamp_micros(F.unix_micros(now) + F.lit(horizon_hours * 3_600_000_000))
    held = states.where(F.col("due") <= until).withColumn("retrievability", F.round(M.retrievability(F.col("stability"), M.whole_days(F.col("last"), now)), 4))
    return held.withColumn("place", F.row_number().over(Window.partitionBy("learner").orderBy("retrievability", "unit")))


def sittings(log: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """``log`` with ``sitting``, numbered from 1 for each learner; one ends where more than the gap passes."""
    by_time = Window.partitionBy("learner").orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_time)) > gap_minutes * 60_000_000
    return log.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("sitting", F.sum("_new").over(by_time)).drop("_new")


def current_sitting(log: DataFrame, now: Column, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """``(learner, start, asks)`` of sittings that still go on at ``now``."""
    per = sittings(log, gap_minutes).groupBy("learner", "sitting").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("asks"))
    last = per.withColumn("_n", F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("sitting")))).where("_n = 1")
    return last.where(F.unix_micros(now) - F.unix_micros("end") <= gap_minutes * 60_000_000).select("learner", "start", "asks")


def recently_shown(log: DataFrame, k: int = 3) -> DataFrame:
    """The last ``k`` entries of each learner's last sitting."""
    held = sittings(log).withColumn("_last", F.max("sitting").over(Window.partitionBy("learner"))).where("sitting = _last")
    return held.withColumn("back", F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("back") <= k).drop("_last", "sitting")


def latest(log: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of the last entry of each group."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("l")).select(*keys, "l.*")


def later_count(log: DataFrame, event: Column, counted: Column) -> DataFrame:
    """``(learner, unit, later)``: counted entries of a learner after the last event of each unit."""
    by_time = Window.partitionBy("learner").orderBy("ts", "seq")
    held = log.withColumn("_run", F.sum(counted.cast("int")).over(by_time)).withColumn("_all", F.sum(counted.cast("int")).over(Window.partitionBy("learner")))
    return held.where(event).groupBy("learner", "unit").agg(F.max_by(F.col("_all") - F.col("_run"), F.struct("ts", "seq")).alias("later"))


def streaks(reviews: DataFrame, today: Column) -> DataFrame:
    """``(learner, days)``: consecutive days with reviews up to today or yesterday."""
    days = reviews.select("learner", F.to_date("ts").alias("day")).where(F.col("day") <= today).distinct()
    run = F.date_sub(F.col("day"), F.row_number().over(Window.partitionBy("learner").orderBy("day")))
    islands = days.withColumn("run", run).groupBy("learner", "run").agg(F.max("day").alias("end"), F.count("*").alias("n"))
    live = F.max(F.when(F.col("end") >= F.date_sub(today, 1), F.col("n")).otherwise(0))
    return islands.groupBy("learner").agg(live.alias("days"))


def learner_figures(states: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """``(learner, learning, young, mature, due_now, reviews_total, reviews_today, retention_30d)``."""
    review = F.col("state") == "review"
    stages = states.groupBy("learner").agg(
        F.count_if(~review).alias("learning"), F.count_if(review & (F.col("stability") < MATURE_DAYS)).alias("young"),
        F.count_if(review & (F.col("stability") >= MATURE_DAYS)).alias("mature"), F.count_if(F.col("due") <= now).alias("due_now"),
    )
    recent = F.col("ts") >= now - F.expr("interval 30 days")
    log = reviews.groupBy("learner").agg(
        F.count("*").alias("reviews_total"), F.count_if(F.to_date("ts") == F.to_date(now)).alias("reviews_today"),
        F.bround(F.avg(F.when(recent, (F.col("rating") > 1).cast("double"))), 3).alias("retention_30d"),
    )
    return stages.join(log, "learner")


def band_coverage(units: DataFrame, seen: DataFrame, band: int = BAND) -> DataFrame:
    """``(band, seen, total)``: units of each band of ranks, and those that are in ``seen(unit)``."""
    held = units.join(seen.select("unit").distinct().withColumn("_seen", F.lit(1)), "unit", "left")
    start = (F.floor((F.col("rank") - 1) / band) * band + 1).cast("long")
    return held.groupBy(start.alias("band")).agg(F.count("_seen").alias("seen"), F.count("*").alias("total"))


def next_in_rotation(cards: DataFrame, shown: DataFrame) -> DataFrame:
    """``(unit, card)``: the card after the one last shown in the unit's order, the first one after the last or if none was."""
    order = Window.partitionBy("unit").orderBy("place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = cards.withColumn("_next", F.coalesce(F.lead("card").over(order), F.first("card").over(whole))).withColumn("_first", F.first("card").over(whole))
    last = shown.select("unit", F.col("card").alias("_shown"))
    joined = held.join(last, "unit", "left")
    return joined.groupBy("unit").agg(F.coalesce(F.max(F.when(F.col("card") == F.col("_shown"), F.col("_next"))), F.max("_first")).alias("card"))
