"""Costs: bills against logs, attempts, repairs, months, budgets and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconciled(billed: DataFrame, logged: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two sets of sums by day, model and mode; what one side lacks is 0."""
    a = billed.groupBy(*keys).agg(F.sum("tokens").alias("billed_tokens"), F.sum("cost").alias("billed_cost"))
    b = logged.groupBy(*keys).agg(F.sum("tokens").alias("logged_tokens"), F.sum("cost").alias("logged_cost"))
    held = a.join(b, keys, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    held = held.select(*keys, zero("billed_tokens"), F.round(F.coalesce("billed_cost", F.lit(0.0)), 6).alias("billed_cost"), zero("logged_tokens"), F.round(F.coalesce("logged_cost", F.lit(0.0)), 6).alias("logged_cost"))
    return held.withColumn("difference", F.round(F.col("billed_cost") - F.col("logged_cost"), 6))


def attempts_by_day(log: DataFrame) -> DataFrame:
    """``(day, calls, attempts, retried_calls, failed_attempts, failed_calls)``; a call failed if all of its attempts did."""
    ok = F.col("outcome") == "ok"
    per_call = log.groupBy("day", "call_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.count_if(ok & (F.col("attempt") > 1)).alias("retried"),
    )
    return per_call.groupBy("day").agg(
        F.sum("ok").alias("calls"), F.sum("n").alias("attempts"), F.sum("retried").alias("retried_calls"),
        F.sum(F.col("n") - F.col("ok")).alias("failed_attempts"), F.count_if((F.col("ok") == 0) & F.col("call_id").isNotNull()).alias("failed_calls"),
    )


def day_modes(log: DataFrame) -> DataFrame:
    """``(day, mode)``: the mode of a day if it has one only, else ``ambiguous``."""
    return log.groupBy("day").agg(F.when(F.min("mode") == F.max("mode"), F.min("mode")).otherwise(F.lit("ambiguous")).alias("mode"))


def adjustments(pairs: DataFrame, least: float = 1e-6) -> DataFrame:
    """Rows that make a log agree with its bill: billed less logged, by day, where that is ``least`` or more."""
    day = pairs.groupBy("day").agg(F.round(F.sum("difference"), 6).alias("cost_usd"))
    return day.where(F.abs("cost_usd") >= least).select("day", "cost_usd", F.lit("adjustment").alias("outcome"))


def months(log: DataFrame, budget: float) -> DataFrame:
    """``(month, spent, remaining, over)``."""
    per = log.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.round(F.sum("cost"), 6).alias("spent"))
    return per.withColumn("remaining", F.round(F.greatest(F.lit(budget) - F.col("spent"), F.lit(0.0)), 6)).withColumn("over", F.col("spent") > budget)


def month_to_date(log: DataFrame) -> DataFrame:
    """``log`` with the cost of its month up to each row. Days are summed first, so only a day's rows are ordered with each other."""
    day = log.groupBy(F.to_date("ts").alias("day")).agg(F.sum("cost").alias("cost"))
    along = Window.partitionBy(F.trunc("day", "month")).orderBy("day")
    return day.withColumn("to_date", F.round(F.sum("cost").over(along), 4)).withColumn("cost", F.round("cost", 4))


def over_rate(log: DataFrame, key: str, most: int, seconds: int) -> DataFrame:
    """``log`` with calls of the same key in the seconds up to each, and whether they are too many."""
    recent = Window.partitionBy(key).orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("calls", F.count("*").over(recent)).withColumn("over", F.col("calls") > most)


def budgeted_batches(rows: DataFrame, group: str, order: list[Column], size: Column, batch: int, budget: int) -> DataFrame:
    """Whole batches of ``batch`` rows of each group, in order, as long as their sum keeps within the budget."""
    by = Window.partitionBy(group).orderBy(*order)
    held = rows.withColumn("size", size).withColumn("batch", F.floor((F.row_number().over(by) - 1) / batch).cast("long"))
    per = held.groupBy(group, "batch").agg(F.sum("size").alias("chars"), F.count("*").alias("rows"))
    run = F.sum("chars").over(Window.partitionBy(group).orderBy("batch"))
    return per.withColumn("total", run).where(F.col("total") <= budget)


def rank_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and 90th percentile by place (no interpolation) of each group."""
    by = Window.partitionBy(*keys)
    held = rows.withColumn("_i", F.row_number().over(by.orderBy(value)) - 1).withColumn("_n", F.count("*").over(by))
    at = lambda q: F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(value)))
    return held.groupBy(*keys).agg(F.max("_n").alias("n"), at(0.5).alias("median"), at(0.9).alias("p90"))
