"""Which unit comes next: tiers on hand-made logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexspark.operators import session
from lexspark.plans import catalog

NOW = dt.datetime(2026, 3, 1, 12)
REVIEWS = "learner long, unit long, ts timestamp, seq long, rating int"


def tables(spark, states, reviews, requests=(), units=(1, 2, 3)):
    deck = spark.createDataFrame([(u, True, None, u) for u in units], "unit long, learnable boolean, requested_order long, rank long")
    held = spark.createDataFrame(states, "learner long, unit long, pending boolean, due timestamp, last timestamp, chance double")
    return deck, held, spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(list(requests), "learner long, unit long, asked_at timestamp"), spark.createDataFrame([], "learner long, unit long")


def minutes(n):
    return NOW + dt.timedelta(minutes=n)


def test_looping_goes_by_chance_even_for_the_unit_shown_last(spark):
    states = [(1, 1, True, minutes(9000), minutes(-2), 0.9), (1, 2, True, minutes(9000), minutes(-1), 0.5)]
    reviews = [(1, 1, minutes(-2), 1, 1), (1, 2, minutes(-1), 2, 1)]
    got = session.next_units(*tables(spark, states, reviews, units=(1, 2)), F.lit(NOW), session.Settings(cards_per_day=1)).collect()
    assert [(r.tier, r.unit) for r in got] == [("looping", 2)]


def test_the_last_unit_waits_where_another_is_overdue(spark):
    states = [(1, 1, False, minutes(-5), minutes(-200), 0.9), (1, 2, False, minutes(-5), minutes(-1), 0.5)]
    reviews = [(1, 1, minutes(-20000), 1, 3), (1, 2, minutes(-19999), 2, 3)]
    got = session.next_units(*tables(spark, states, reviews), F.lit(NOW)).collect()
    assert [(r.tier, r.unit) for r in got] == [("overdue", 1)]


def test_a_request_without_a_time_is_shown_at_once(spark):
    reviews = [(1, 1, minutes(-2), 1, 3)]
    got = session.next_units(*tables(spark, [(1, 1, False, minutes(9000), minutes(-2), 0.9)], reviews, [(1, 3, None), (1, 2, minutes(-1))]), F.lit(NOW)).collect()
    assert [(r.tier, r.unit) for r in got] == [("requested", 3)]


def test_names_of_queries_do_not_clash():
    with pytest.raises(ValueError):
        catalog._merged([{"a": 1}, {"a": 2}])
    assert "fallback_bands" in catalog.QUERIES and "word_bands" in catalog.ORACLES
