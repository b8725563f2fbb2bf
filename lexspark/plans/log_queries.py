"""Queries over the review log (events) and the ledger (order lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import memory as M
from lexspark.operators import ledger as L
from lexspark.operators import replay as R
from lexspark.storage import stored
from lexspark.plans.tables import LOG, log, read, reviews

#: The moment from which the log is looked at.
NOW = "2024-01-20 12:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as the tables have them, without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def unit_states(spark: SparkSession, d: str) -> DataFrame:
    held = R.unit_states(reviews(spark, d))
    held = _plain(held, "last", "due")
    return held.select("learner", "unit", "state", F.round("stability", 4).alias("stability"), F.round("difficulty", 4).alias("difficulty"), "last", F.date_trunc("minute", "due").cast("timestamp_ntz").alias("due"), "reps", "lapses")


def due_units(spark: SparkSession, d: str) -> DataFrame:
    held = R.due_units(R.unit_states(reviews(spark, d)), _now(), 24)
    return held.select("learner", "unit", F.round("retrievability", 3).alias("retrievability"))


def learner_figures(spark: SparkSession, d: str) -> DataFrame:
    held = stored(reviews(spark, d).where(F.col("ts") <= _now()))
    return R.learner_figures(R.unit_states(held), held, _now())


def sittings(spark: SparkSession, d: str) -> DataFrame:
    held = R.sittings(log(spark, d), 240)
    return _plain(held.groupBy("learner", "sitting").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("asks")), "start", "end")


def current_sittings(spark: SparkSession, d: str) -> DataFrame:
    return _plain(R.current_sitting(log(spark, d).where(F.col("ts") <= _now()), _now(), 720), "start")


def recently_shown(spark: SparkSession, d: str) -> DataFrame:
    return R.recently_shown(log(spark, d)).select("learner", "seq", "back")


def streaks(spark: SparkSession, d: str) -> DataFrame:
    return R.streaks(reviews(spark, d), F.to_date(_now()))


def since_reset(spark: SparkSession, d: str) -> DataFrame:
    return _plain(R.since_reset(log(spark, d)).groupBy("learner").agg(F.count("*").alias("n"), F.min("ts").alias("start")), "start")


def latest_ratings(spark: SparkSession, d: str) -> DataFrame:
    return _plain(R.latest(reviews(spark, d), ["learner", "unit"], ["rating", "ts"]), "ts")


def reviews_since(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of a learner after the last lapse of each unit."""
    return R.later_count(reviews(spark, d), F.col("rating") == 1, F.col("rating") > 0)


def band_coverage(spark: SparkSession, d: str) -> DataFrame:
    units = read(spark, d, "part").select(F.col("p_partkey").alias("rank"), F.pmod("p_partkey", F.lit(150)).cast("long").alias("unit"))
    return R.band_coverage(units, reviews(spark, d).select("unit"))


def rotation(spark: SparkSession, d: str) -> DataFrame:
    """The supplier that comes after the one last asked of each part."""
    items = read(spark, d, "lineitem")
    cards = items.select(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias("card")).distinct().withColumn("place", F.col("card"))
    shown = items.groupBy(F.col("l_partkey").alias("unit")).agg(F.max_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("card"))
    return R.next_in_rotation(cards, shown)


def merged_logs(spark: SparkSession, d: str) -> DataFrame:
    """Two devices' logs of conversations: even turns are on both, the first device's row wins."""
    c = read(spark, d, "conversations")
    a = c.where("conv_id % 3 < 2").withColumn("device", F.lit(1))
    b = c.where("conv_id % 3 > 0").withColumn("device", F.lit(2))
    held = R.merged_logs(a.unionByName(b), ["conv_id", "turn"], F.col("device"), [F.col("role"), F.col("text")])
    return held.groupBy("device", "role").agg(F.count("*").alias("n"))


def _billed(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.to_date("o_orderdate").alias("day"), F.lower("o_orderstatus").alias("mode"), F.lit(1).cast("long").alias("tokens"), F.col("o_totalprice").cast("double").alias("cost"))


def _logged(spark: SparkSession, d: str) -> DataFrame:
    i = read(spark, d, "lineitem")
    return i.select(F.to_date("l_shipdate").alias("day"), F.lower("l_linestatus").alias("mode"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_extendedprice").cast("double").alias("cost"))


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    held = L.reconciled(_billed(spark, d), _logged(spark, d), ["day", "mode"])
    two = lambda c: F.round(c, 2).alias(c)
    return held.select("day", "mode", "billed_tokens", two("billed_cost"), "logged_tokens", two("logged_cost"))


def adjustments(spark: SparkSession, d: str) -> DataFrame:
    held = L.adjustments(L.reconciled(_billed(spark, d), _logged(spark, d), ["day", "mode"]))
    return held.select("day", F.round("cost_usd", 2).alias("cost_usd"), "outcome")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    i = read(spark, d, "lineitem")
    return L.attempts_by_day(i.select(F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("attempt"), F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("outcome")))


def day_modes(spark: SparkSession, d: str) -> DataFrame:
    return L.day_modes(_billed(spark, d))


def month_budget(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").cast("double").alias("cost"))
    held = L.months(o, 2_000_000.0)
    return held.withColumn("spent", F.round("spent", 2)).withColumn("remaining", F.round("remaining", 2))


def month_to_date(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").cast("double").alias("cost"))
    return L.month_to_date(o).select("day", F.round("cost", 2).alias("cost"), F.round("to_date", 2).alias("to_date"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    held = L.over_rate(read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", 3, 86_400)
    return held.select("event_id", "calls", "over")


def budgeted_batches(spark: SparkSession, d: str) -> DataFrame:
    """Whole batches of fifty documents of a source, in order, within a budget of characters."""
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars")
    return L.budgeted_batches(docs, "source", [F.col("doc_id")], F.col("n_chars"), 5, 60_000)


def rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return L.rank_percentiles(read(spark, d, "part").select("p_brand", "p_size"), ["p_brand"], "p_size")


QUERIES = {
    f.__name__: f
    for f in (
        unit_states, due_units, learner_figures, sittings, current_sittings, recently_shown, streaks, since_reset, latest_ratings, reviews_since, band_coverage,
        rotation, merged_logs, reconciliation, adjustments, attempts, day_modes, month_budget, month_to_date, rate_limit, budgeted_batches, rank_percentiles,
    )
}

_W = M.WEIGHTS
_DECAY, _FACTOR = M.curve()
_FIRST = f"(CASE r WHEN 1 THEN {_W[0]} WHEN 2 THEN {_W[1]} WHEN 3 THEN {_W[2]} ELSE {_W[3]} END)::DOUBLE"
_GROWTH = f"exp({_W[17]} * (r - 3 + {_W[18]})) * pow(s, -{_W[19]})"
_LEFT = f"(1 - pow(1 + {_FACTOR!r}::DOUBLE * days / s, {_DECAY}))"
_NEXT = f"""greatest(CASE WHEN days < 1 THEN s * CASE WHEN r = 1 THEN {_GROWTH} ELSE greatest({_GROWTH}, 1.0) END
  WHEN r = 1 THEN least({_W[11]} * pow(d, -{_W[12]}) * (pow(s + 1, {_W[13]}) - 1) * exp({_LEFT} * {_W[14]}), s / exp({_W[17] * _W[18]!r}))
  ELSE s * (1 + exp({_W[8]}) * (11 - d) * pow(s, -{_W[9]}) * (exp({_LEFT} * {_W[10]}) - 1) * CASE r WHEN 2 THEN {_W[15]} WHEN 4 THEN {_W[16]} ELSE 1.0 END) END, 0.001)"""
_D0 = f"({_W[4]} - exp({_W[5]} * (r - 1)) + 1)"
_D4 = f"({_W[4]} - exp({_W[5]} * 3) + 1)"
_DNEXT = f"least(greatest({_W[7]} * {_D4} + {1 - _W[7]!r} * (d + (10 - d) * (-{_W[6]} * (r - 3)) / 9), 1.0), 10.0)"
_INTERVAL = f"least(greatest(round_even(s / {_FACTOR!r}::DOUBLE * {0.9 ** (1 / _DECAY) - 1!r}::DOUBLE, 0), 1.0), 36500.0)"


def _states(where: str = "TRUE") -> str:
    return f"""WITH RECURSIVE {LOG.strip()}, numbered AS (
  SELECT learner, unit, ts, rating::DOUBLE AS r, row_number() OVER (PARTITION BY learner, unit ORDER BY ts, seq) AS i FROM reviews WHERE {where}
), fold AS (
  SELECT learner, unit, i, ts AS last, r AS rating, {_FIRST} AS s, least(greatest({_D0}, 1.0), 10.0)::DOUBLE AS d, CASE WHEN r >= 3 THEN 'review' ELSE 'learning' END AS state, 0 AS lapses FROM numbered WHERE i = 1
  UNION ALL
  SELECT learner, unit, i, ts, r, {_NEXT}::DOUBLE, ({_DNEXT})::DOUBLE,
    CASE WHEN r >= 3 THEN 'review' WHEN state = 'review' AND r = 2 THEN 'review' WHEN state = 'review' THEN 'relearning' ELSE state END, lapses + CASE WHEN state = 'review' AND r = 1 THEN 1 ELSE 0 END
  FROM (SELECT n.learner, n.unit, n.i, n.ts, n.r, f.s, f.d, f.state, f.lapses, greatest(floor((epoch_us(n.ts) - epoch_us(f.last)) / 86400000000.0), 0)::DOUBLE AS days
        FROM fold f JOIN numbered n ON n.learner = f.learner AND n.unit = f.unit AND n.i = f.i + 1)
), last_of AS (
  SELECT *, make_timestamp(epoch_us(last) + CAST(60000000 * (CASE WHEN state = 'review' THEN {_INTERVAL} * 1440 WHEN rating = 2 THEN 15.0 ELSE 10.0 END) AS BIGINT)) AS due
  FROM fold QUALIFY row_number() OVER (PARTITION BY learner, unit ORDER BY i DESC) = 1
)"""


_SIT = f"""WITH {LOG}, gaps AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY learner ORDER BY ts, seq)) <= {{gap}} * 60000000::BIGINT THEN 0 ELSE 1 END AS fresh FROM log WHERE {{where}}),
sat AS (SELECT *, sum(fresh) OVER (PARTITION BY learner ORDER BY ts, seq) AS sitting FROM gaps)"""
_PAIRS = """WITH b AS (SELECT CAST(o_orderdate AS DATE) AS day, lower(o_orderstatus) AS mode, count(*) AS t, sum(CAST(o_totalprice AS DOUBLE)) AS c FROM orders GROUP BY ALL),
l AS (SELECT CAST(l_shipdate AS DATE) AS day, lower(l_linestatus) AS mode, sum(CAST(l_quantity AS BIGINT)) AS t, sum(CAST(l_extendedprice AS DOUBLE)) AS c FROM lineitem GROUP BY ALL),
p AS (SELECT coalesce(b.day, l.day) AS day, coalesce(b.mode, l.mode) AS mode, coalesce(b.t, 0) AS bt, coalesce(b.c, 0) AS bc, coalesce(l.t, 0) AS lt, coalesce(l.c, 0) AS lc FROM b FULL JOIN l ON b.day = l.day AND b.mode = l.mode)"""

ORACLES = {
    "unit_states": f"{_states()} SELECT learner, unit, state, round(s, 4) AS stability, round(d, 4) AS difficulty, last, date_trunc('minute', due) AS due, CAST(i AS INTEGER) AS reps, CAST(lapses AS INTEGER) AS lapses FROM last_of",
    "due_units": f"""{_states()} SELECT learner, unit, round(round(pow(1 + {_FACTOR!r}::DOUBLE * greatest(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last)) / 86400000000.0), 0) / s, {_DECAY}), 4), 3) AS retrievability
FROM last_of WHERE due <= TIMESTAMP '{NOW}' + INTERVAL 24 HOUR""",
    "learner_figures": f"""{_states(f"ts <= TIMESTAMP '{NOW}'")}, a AS (SELECT learner, count(*) FILTER (state <> 'review') AS learning, count(*) FILTER (state = 'review' AND s < 21) AS young,
  count(*) FILTER (state = 'review' AND s >= 21) AS mature, count(*) FILTER (due <= TIMESTAMP '{NOW}') AS due_now FROM last_of GROUP BY learner),
b AS (SELECT learner, count(*) AS reviews_total, count(*) FILTER (CAST(ts AS DATE) = DATE '{NOW[:10]}') AS reviews_today,
  round_even(avg(CASE WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN CAST(rating > 1 AS INTEGER)::DOUBLE END), 3) AS retention_30d FROM reviews WHERE ts <= TIMESTAMP '{NOW}' GROUP BY learner)
SELECT a.*, reviews_total, reviews_today, retention_30d FROM a JOIN b ON a.learner = b.learner""",
    "sittings": f"{_SIT.format(gap=240, where='TRUE')} SELECT learner, CAST(sitting AS BIGINT) AS sitting, min(ts) AS start, max(ts) AS end, count(*) AS asks FROM sat GROUP BY learner, sitting",
    "current_sittings": f"""{_SIT.format(gap=720, where=f"ts <= TIMESTAMP '{NOW}'")}
SELECT learner, start, asks FROM (SELECT learner, sitting, min(ts) AS start, max(ts) AS e, count(*) AS asks FROM sat GROUP BY learner, sitting QUALIFY row_number() OVER (PARTITION BY learner ORDER BY sitting DESC) = 1)
WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(e) <= 720 * 60000000::BIGINT""",
    "recently_shown": f"""{_SIT.format(gap=60, where='TRUE')}
SELECT learner, seq, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ts DESC, seq DESC) AS back FROM (SELECT *, max(sitting) OVER (PARTITION BY learner) AS m FROM sat) WHERE sitting = m) WHERE back <= 3""",
    "streaks": f"""WITH {LOG}, d AS (SELECT DISTINCT learner, CAST(ts AS DATE) AS day FROM reviews WHERE CAST(ts AS DATE) <= DATE '{NOW[:10]}'),
i AS (SELECT learner, day, day - CAST(row_number() OVER (PARTITION BY learner ORDER BY day) AS INTEGER) AS run FROM d), s AS (SELECT learner, run, max(day) AS e, count(*) AS n FROM i GROUP BY ALL)
SELECT learner, max(CASE WHEN e >= DATE '{NOW[:10]}' - 1 THEN n ELSE 0 END) AS days FROM s GROUP BY learner""",
    "since_reset": f"""WITH {LOG}, m AS (SELECT *, max(CASE WHEN type = 'reset' THEN {{'ts': ts, 'seq': seq}} END) OVER (PARTITION BY learner) AS r FROM log)
SELECT learner, count(*) AS n, min(ts) AS start FROM m WHERE r IS NULL OR {{'ts': ts, 'seq': seq}} > r GROUP BY learner""",
    "latest_ratings": f"WITH {LOG} SELECT learner, unit, CAST(rating AS INTEGER) AS rating, ts FROM reviews QUALIFY row_number() OVER (PARTITION BY learner, unit ORDER BY ts DESC, seq DESC) = 1",
    "reviews_since": f"""WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY learner) AS total FROM reviews)
SELECT learner, unit, min(total - i) AS later FROM n WHERE rating = 1 GROUP BY learner, unit""",
    "band_coverage": f"""WITH {LOG}, seen AS (SELECT DISTINCT unit FROM reviews)
SELECT CAST(floor((p_partkey - 1) / 500) * 500 + 1 AS BIGINT) AS band, count(seen.unit) AS seen, count(*) AS total FROM part LEFT JOIN seen ON p_partkey % 150 = seen.unit GROUP BY 1""",
    "rotation": """WITH c AS (SELECT DISTINCT l_partkey AS unit, l_suppkey AS card FROM lineitem),
n AS (SELECT *, coalesce(lead(card) OVER (PARTITION BY unit ORDER BY card), min(card) OVER (PARTITION BY unit)) AS next FROM c),
s AS (SELECT l_partkey AS unit, l_suppkey AS card FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1)
SELECT n.unit, n.next AS card FROM n JOIN s ON n.unit = s.unit AND n.card = s.card""",
    "merged_logs": """WITH pair AS (SELECT *, 1 AS device FROM conversations WHERE conv_id % 3 < 2 UNION ALL SELECT *, 2 FROM conversations WHERE conv_id % 3 > 0)
SELECT CAST(device AS INTEGER) AS device, role, count(*) AS n FROM (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY device, role, text) = 1) GROUP BY ALL""",
    "reconciliation": f"{_PAIRS} SELECT day, mode, CAST(bt AS BIGINT) AS billed_tokens, round(bc, 2) AS billed_cost, CAST(lt AS BIGINT) AS logged_tokens, round(lc, 2) AS logged_cost FROM p",
    "adjustments": f"{_PAIRS} SELECT day, round(sum(bc - lc), 2) AS cost_usd, 'adjustment' AS outcome FROM p GROUP BY day HAVING abs(sum(bc - lc)) >= 1e-6",
    "attempts": """WITH a AS (SELECT CAST(l_shipdate AS DATE) AS day, l_orderkey AS call, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber > 1) AS retried FROM lineitem GROUP BY ALL)
SELECT day, CAST(sum(ok) AS BIGINT) AS calls, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(retried) AS BIGINT) AS retried_calls, CAST(sum(n - ok) AS BIGINT) AS failed_attempts, count(*) FILTER (ok = 0) AS failed_calls FROM a GROUP BY day""",
    "day_modes": "SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN count(DISTINCT lower(o_orderstatus)) = 1 THEN min(lower(o_orderstatus)) ELSE 'ambiguous' END AS mode FROM orders GROUP BY 1",
    "month_budget": """WITH m AS (SELECT strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month, sum(CAST(o_totalprice AS DOUBLE)) AS c FROM orders GROUP BY 1)
SELECT month, round(c, 2) AS spent, round(greatest(2000000.0 - c, 0.0), 2) AS remaining, c > 2000000.0 AS over FROM m""",
    "month_to_date": """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DOUBLE)) AS c FROM orders GROUP BY 1)
SELECT day, round(c, 2) AS cost, round(sum(c) OVER (PARTITION BY date_trunc('month', day) ORDER BY day), 2) AS to_date FROM d""",
    "rate_limit": """SELECT event_id, count(*) OVER w AS calls, count(*) OVER w > 3 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""",
    "budgeted_batches": """WITH b AS (SELECT source, n_chars, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 5) AS BIGINT) AS batch FROM documents),
p AS (SELECT source, batch, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS rows FROM b GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(sum(chars) OVER (PARTITION BY source ORDER BY batch) AS BIGINT) AS total FROM p) WHERE total <= 60000""",
    "rank_percentiles": """WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, max(n) AS n, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN p_size END) AS median, max(CASE WHEN i = least(floor(n * 0.9), n - 1) THEN p_size END) AS p90 FROM r GROUP BY p_brand""",
}
