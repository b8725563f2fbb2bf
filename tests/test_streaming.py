"""Streams give what batches give on the same log."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.operators import replay
from lexspark.plans import tables
from lexspark.streaming import replay as stream

SF = "/root/testdata/sf0.001"


def run(df, spark, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_states_of_the_stream_are_those_of_the_batch(spark, tmp_path):
    log = tables.log(spark, SF).where("learner < 6").withColumn("ts", F.date_trunc("second", "ts")).cache()
    cut = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    log.where(F.col("seq") <= cut).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    log.where(F.col("seq") > cut).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    entries = stream.log_stream(spark, str(tmp_path / "log"), files=10)
    got = run(stream.state_stream(entries), spark, "states", "update")
    last = got.withColumn("n", F.row_number().over(Window.partitionBy("learner", "unit").orderBy(F.desc("reps")))).where("n = 1").drop("n")
    want = replay.unit_states(log.where("rating is not null and unit is not null"))
    rows = lambda df: sorted((r.learner, r.unit, r.state, round(r.stability, 6), round(r.difficulty, 6), r["last"], r.reps, r.lapses) for r in df.collect())
    assert rows(last) == rows(want)


def test_copies_of_entries_come_once(spark, tmp_path):
    log = tables.log(spark, SF).where("seq < 200").withColumn("ts", F.date_trunc("second", "ts")).cache()
    for _ in range(2):
        log.coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    got = run(stream.once(stream.log_stream(spark, str(tmp_path / "log"))), spark, "entries", "append")
    assert got.count() == log.dropDuplicates(["learner", "type", "unit", "ts"]).count()


def test_windows_count_all_reviews(spark, tmp_path):
    log = tables.log(spark, SF).cache()
    log.coalesce(1).write.json(str(tmp_path / "log"))
    entries = stream.log_stream(spark, str(tmp_path / "log"))
    got = run(stream.asks_by_window(entries), spark, "windows", "complete")
    assert got.agg(F.sum("asks")).first()[0] == log.where("type = 'review'").count()
    assert run(stream.sitting_stream(entries), spark, "sittings_seen", "append").count() > 0
