"""Queries on what learners are asked next. Units are parts, reviews are events, sign-up events ask for a unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators import replay as R
from lexspark.operators import session as N
from lexspark.plans.tables import LOG, log, read, reviews

NOW = "2024-01-20 12:00:00"
SETTINGS = N.Settings(cards_per_day=20, new_per_day=4, requested_per_day=2, gap_minutes=1_440)


def _now():
    return F.to_timestamp(F.lit(NOW))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).where(F.col("ts") <= _now())


def _deck(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    return read(spark, d, "part").select(key.alias("unit"), key.alias("rank"), F.when(size == 50, key).alias("requested_order"), ((size >= 3) & (size != 7)).alias("learnable"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for the memory model that SQL can say: due after as many days as reviews times the last rating."""
    held = _reviews(spark, d).groupBy("learner", "unit").agg(F.count("*").alias("reps"), F.max("ts").alias("last"), F.max_by("rating", F.struct("ts", "seq")).alias("rating"))
    due = F.timestamp_micros(F.unix_micros("last") + F.col("reps") * F.col("rating") * F.lit(86_400_000_000))
    return held.select("learner", "unit", (F.col("rating") == 1).alias("pending"), due.alias("due"), "last", (F.col("reps") / (F.col("reps") + F.datediff(_now(), "last"))).alias("chance"))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    asked = log(spark, d).where((F.col("type") == "reset") & (F.col("ts") <= _now()) & F.col("unit").isNotNull())
    return asked.groupBy("learner", "unit").agg(F.min("ts").alias("asked_at"))


def _closed(spark: SparkSession, d: str) -> DataFrame:
    """Units bought three times are known."""
    return _reviews(spark, d).where("rating = 4").groupBy("learner", "unit").agg(F.count("*").alias("n")).where("n >= 3").select("learner", "unit")


def day_budgets(spark: SparkSession, d: str) -> DataFrame:
    return N.day_budgets(_reviews(spark, d), _now(), SETTINGS)


def pending_units(spark: SparkSession, d: str) -> DataFrame:
    return N.pending_units(_states(spark, d), _reviews(spark, d), _now(), SETTINGS).select("learner", "unit")


def requested_units(spark: SparkSession, d: str) -> DataFrame:
    return N.requested_units(_deck(spark, d), _states(spark, d), _reviews(spark, d), _requests(spark, d), _now(), SETTINGS).select("learner", "unit")


def next_new_units(spark: SparkSession, d: str) -> DataFrame:
    return N.next_new(_deck(spark, d), _states(spark, d).select("learner", "unit"), _requests(spark, d))


def untriaged_units(spark: SparkSession, d: str) -> DataFrame:
    return N.untriaged(_deck(spark, d), _states(spark, d), _reviews(spark, d).select("learner"))


def next_units(spark: SparkSession, d: str) -> DataFrame:
    return N.next_units(_deck(spark, d), _states(spark, d), _reviews(spark, d), _requests(spark, d), _closed(spark, d), _now(), SETTINGS)


def unit_stages(spark: SparkSession, d: str) -> DataFrame:
    marks = log(spark, d).where("type = 'reset' and unit is not null").groupBy("learner", "unit").agg(F.max("seq").alias("seq"))
    source = F.when(F.col("seq") % 3 == 0, "defer").when(F.col("seq") % 3 == 1, "never").otherwise("known")
    return N.stages(R.unit_states(reviews(spark, d)), marks.select("learner", "unit", source.alias("source"))).where("stage in ('known', 'never', 'deferred')")


QUERIES = {f.__name__: f for f in (day_budgets, pending_units, requested_units, next_new_units, untriaged_units, next_units, unit_stages)}

_BASE = rf"""WITH {LOG}, r AS (SELECT * FROM reviews WHERE ts <= TIMESTAMP '{NOW}'),
deck AS (SELECT p_partkey AS unit, p_partkey AS rank, CASE WHEN p_size = 50 THEN p_partkey END AS requested_order, p_size >= 3 AND p_size <> 7 AS learnable FROM part),
agg AS (SELECT learner, unit, count(*) AS reps, max(ts) AS last, arg_max(rating, (ts, seq)) AS rating FROM r GROUP BY learner, unit),
states AS (SELECT learner, unit, rating = 1 AS pending, last + to_days(CAST(reps * rating AS INTEGER)) AS due, last, reps / (reps + date_diff('day', CAST(last AS DATE), DATE '{NOW[:10]}'))::DOUBLE AS chance FROM agg),
requests AS (SELECT learner, unit, min(ts) AS asked_at FROM log WHERE type = 'reset' AND unit IS NOT NULL AND ts <= TIMESTAMP '{NOW}' GROUP BY learner, unit),
closed AS (SELECT learner, unit FROM r WHERE rating = 4 GROUP BY learner, unit HAVING count(*) >= 3),
gaps AS (SELECT *, ts - lag(ts) OVER (PARTITION BY learner ORDER BY ts, seq) > INTERVAL 1440 MINUTE AS brk FROM r),
sit AS (SELECT learner, ts, sum(CASE WHEN coalesce(brk, true) THEN 1 ELSE 0 END) OVER (PARTITION BY learner ORDER BY ts, seq) AS n FROM gaps),
spans AS (SELECT learner, n, min(ts) AS started, max(ts) AS ended FROM sit GROUP BY learner, n),
starts AS (SELECT learner, started FROM spans QUALIFY row_number() OVER (PARTITION BY learner ORDER BY n DESC) = 1 AND TIMESTAMP '{NOW}' - ended <= INTERVAL 1440 MINUTE),
pend AS (SELECT s.* FROM states s LEFT JOIN starts t ON s.learner = t.learner
  WHERE pending AND (t.started IS NULL OR last < t.started OR (SELECT count(*) FROM r x WHERE x.learner = s.learner AND x.ts > s.last) >= 3)),
free AS (SELECT *, coalesce(lag(rating = 1) OVER w, false) AND NOT coalesce(lag(rating = 1, 2) OVER w, false) AS free, row_number() OVER w = 1 AS first FROM r WINDOW w AS (PARTITION BY learner, unit ORDER BY ts, seq)),
budget AS (SELECT learner, count(*) FILTER (CAST(ts AS DATE) = DATE '{NOW[:10]}' AND NOT free) AS spent, count(*) FILTER (CAST(ts AS DATE) = DATE '{NOW[:10]}' AND first) AS new_today, count(*) FILTER (first) AS introduced FROM free GROUP BY learner)"""

_WANTED = rf""", used AS (SELECT q.learner, count(*) AS n FROM requests q JOIN (SELECT learner, unit, min(ts) AS f FROM r GROUP BY ALL) x USING (learner, unit) WHERE CAST(f AS DATE) = DATE '{NOW[:10]}' GROUP BY q.learner),
wanted AS (SELECT q.learner, q.unit, q.asked_at FROM requests q JOIN deck d ON d.unit = q.unit AND d.learnable LEFT JOIN used u ON u.learner = q.learner
  WHERE NOT EXISTS (SELECT 1 FROM STATES s WHERE s.learner = q.learner AND s.unit = q.unit) AND NOT EXISTS (SELECT 1 FROM CLOSED c WHERE c.learner = q.learner AND c.unit = q.unit)
    AND (SELECT count(*) FROM r x WHERE x.learner = q.learner AND x.ts > q.asked_at) >= 3
  QUALIFY row_number() OVER (PARTITION BY q.learner ORDER BY q.asked_at, q.unit) <= 2 - coalesce(any_value(u.n) OVER (PARTITION BY q.learner), 0))"""

_FIRST = """, everyone AS (SELECT learner FROM states UNION SELECT learner FROM requests),
fresh AS (SELECT e.learner, d.unit FROM everyone e JOIN deck d ON d.learnable LEFT JOIN requests q ON q.learner = e.learner AND q.unit = d.unit
  WHERE NOT EXISTS (SELECT 1 FROM STATES s WHERE s.learner = e.learner AND s.unit = d.unit) AND NOT EXISTS (SELECT 1 FROM CLOSED c WHERE c.learner = e.learner AND c.unit = d.unit)
  QUALIFY row_number() OVER (PARTITION BY e.learner ORDER BY q.asked_at NULLS LAST, CASE WHEN q.unit IS NOT NULL THEN d.unit END, d.requested_order NULLS LAST, d.rank) = 1)"""


def _of(part: str, states: str, closed: str) -> str:
    return part.replace("STATES", states).replace("CLOSED", closed)


_NOBODY = "(SELECT * FROM closed WHERE false)"
_OPEN = "(SELECT s.* FROM states s ANTI JOIN closed c USING (learner, unit))"

ORACLES = {
    "day_budgets": _BASE + ' SELECT learner, spent, CAST(greatest(20 - spent, 0) AS BIGINT) AS "left", new_today, introduced FROM budget',
    "pending_units": _BASE + " SELECT learner, unit FROM pend",
    "requested_units": _BASE + _of(_WANTED, "states", _NOBODY) + " SELECT learner, unit FROM wanted",
    "next_new_units": _BASE + _of(_FIRST, "states", _NOBODY) + " SELECT learner, unit FROM fresh",
    "untriaged_units": _BASE + """ SELECT l.learner, count(d.unit) AS n, arg_min(d.unit, d.rank) AS first FROM (SELECT DISTINCT learner FROM r) l
      JOIN deck d ON d.learnable WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.learner = l.learner AND s.unit = d.unit) GROUP BY l.learner""",
    "next_units": _BASE + _of(_WANTED, _OPEN, "closed") + _of(_FIRST, _OPEN, "closed") + rf""", live AS (SELECT s.* FROM states s ANTI JOIN closed c USING (learner, unit)),
      cand AS (
        SELECT learner, unit, 0 AS tier, epoch_us(asked_at)::DOUBLE AS k1, unit::DOUBLE AS k2 FROM wanted
        UNION ALL SELECT p.learner, p.unit, 1, chance, rank FROM pend p JOIN live USING (learner, unit, chance) JOIN deck USING (unit)
        UNION ALL SELECT learner, unit, 2, chance, rank FROM live JOIN deck USING (unit) WHERE due <= TIMESTAMP '{NOW}'
        UNION ALL SELECT f.learner, f.unit, 3, 0, 0 FROM fresh f LEFT JOIN budget b USING (learner) WHERE coalesce(20 - spent, 20) > 0 AND coalesce(new_today, 0) < 4
        UNION ALL SELECT learner, unit, 4, chance, rank FROM live JOIN deck USING (unit) WHERE due <= TIMESTAMP '{NOW}' + INTERVAL 1440 MINUTE
        UNION ALL SELECT learner, unit, 5, chance, rank FROM live JOIN deck USING (unit) WHERE pending),
      insit AS (SELECT r.learner, r.unit, row_number() OVER (PARTITION BY r.learner ORDER BY ts DESC, seq DESC) AS back FROM r JOIN starts USING (learner) WHERE ts >= started),
      asked AS (SELECT learner, unit, count(*) AS asks, min(back) AS back FROM insit GROUP BY learner, unit),
      lastu AS (SELECT learner, arg_max(unit, (ts, seq)) AS last_unit FROM r GROUP BY learner),
      ok AS (SELECT c.*, coalesce(c.unit = l.last_unit, false) AS again FROM cand c LEFT JOIN asked a ON a.learner = c.learner AND a.unit = c.unit LEFT JOIN lastu l ON l.learner = c.learner
        WHERE (tier = 3 OR coalesce(asks, 0) < 4) AND NOT (tier IN (1, 2, 4) AND coalesce(back, 1000000) <= 3) AND NOT (tier IN (1, 4) AND coalesce(c.unit = l.last_unit, false)))
      SELECT learner, ['requested', 'pending', 'overdue', 'new', 'ahead', 'looping'][tier + 1] AS tier, unit FROM ok
      QUALIFY row_number() OVER (PARTITION BY learner ORDER BY tier, again AND tier IN (0, 2), k1, k2, unit) = 1""",
    "unit_stages": f"""WITH {LOG} SELECT learner, unit, CASE max(seq) % 3 WHEN 0 THEN 'deferred' WHEN 1 THEN 'never' ELSE 'known' END AS stage FROM log WHERE type = 'reset' AND unit IS NOT NULL GROUP BY learner, unit""",
}
