"""Interval, as-of and per-machine window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.asof import counts_in_past, failure_horizon, inside_intervals, last_event_before
from ..operators.series import every_nth, first_last, last_n
from ..sources.events import READINGS_CTE, event_readings
from ..spec import EVENTS_SPEC
from .catalog import register
from .q_prepare import LIFECYCLE_CTES, life

S = EVENTS_SPEC
COMPONENTS = ("comp1", "comp2", "comp3", "comp4")
ERROR_TYPES = ("error1", "error2", "error3", "error4", "error5")

INTERVALS_CTE = f"""WITH {READINGS_CTE},
iv AS (SELECT user_id, ts AS s, ts + to_hours(CAST(CAST(k AS INTEGER) % 6 + 1 AS BIGINT)) AS e
       FROM r WHERE event_type = 'purchase')"""


def _intervals(spark, sf):
    r = event_readings(spark, sf)
    iv = r.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("start"),
        F.expr("ts + make_dt_interval(0, CAST(k AS INT) % 6 + 1, 0, 0)").alias("end"))
    rd = r.where(F.col("event_type") != "purchase").select("event_id", "user_id", "ts")
    return inside_intervals(rd, iv, S)


@register("readings_in_failure", INTERVALS_CTE + """
SELECT event_id, user_id, ts FROM r WHERE event_type <> 'purchase'
  AND EXISTS (SELECT 1 FROM iv WHERE iv.user_id = r.user_id AND iv.s <= r.ts AND r.ts < iv.e)""")
def q_readings_in_failure(spark, sf):
    """C2 (semi): readings inside some failure interval of their machine."""
    return _intervals(spark, sf).where("in_interval").drop("in_interval")


@register("readings_outside_failure", INTERVALS_CTE + """
SELECT event_id, user_id, ts FROM r WHERE event_type <> 'purchase'
  AND NOT EXISTS (SELECT 1 FROM iv WHERE iv.user_id = r.user_id AND iv.s <= r.ts AND r.ts < iv.e)""")
def q_readings_outside_failure(spark, sf):
    """C2 (anti): readings outside every failure interval."""
    return _intervals(spark, sf).where(~F.col("in_interval")).drop("in_interval")


def _comp_sql(c):
    n = int(c[-1])
    return (f"round(date_diff('microsecond', max(CASE WHEN event_type = 'signup' AND event_id % 4 + 1 = {n} "
            f"THEN ts END) OVER w, ts) / CAST(3600000000 AS DOUBLE), 6) AS since_{c}_h")


@register("hours_since_maintenance", f"""WITH {READINGS_CTE}
SELECT event_id, user_id, ts, {', '.join(_comp_sql(c) for c in COMPONENTS)}
FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_hours_since_maintenance(spark, sf):
    """Hours since the last maintenance of each component (backward as-of)."""
    r = event_readings(spark, sf)
    maint = r.where(F.col("event_type") == "signup").select(
        "user_id", "ts", "event_id", F.concat(F.lit("comp"), (F.col("event_id") % 4 + 1).cast("string")).alias("comp"))
    out = last_event_before(r.select("event_id", "user_id", "ts"), maint, S, COMPONENTS, "comp")
    return out.select("event_id", "user_id", "ts", *[F.round(f"since_{c}_h", 6).alias(f"since_{c}_h") for c in COMPONENTS])


def _err_sql(e):
    n = int(e[-1])
    return (f"count(CASE WHEN event_type = 'error' AND CAST(k AS INTEGER) % 5 + 1 = {n} THEN 1 END) OVER w "
            f"AS {e}_24h")


@register("error_counts_24h", f"""WITH {READINGS_CTE}
SELECT event_id, user_id, ts, {', '.join(_err_sql(e) for e in ERROR_TYPES)}
FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)""")
def q_error_counts_24h(spark, sf):
    """Per reading, errors of each type in the preceding 24 hours (pivoted)."""
    r = event_readings(spark, sf)
    errs = r.where(F.col("event_type") == "error").select(
        "user_id", "ts", F.concat(F.lit("error"), (F.col("k").cast("int") % 5 + 1).cast("string")).alias("etype"))
    return counts_in_past(r.select("event_id", "user_id", "ts"), errs, S, ERROR_TYPES, "etype", 24)


@register("failure_horizon", f"""WITH {READINGS_CTE},
fl AS (SELECT DISTINCT user_id, ts FROM r WHERE event_type = 'purchase'),
x AS (SELECT r.event_id, r.user_id, r.ts,
             (SELECT min(fl.ts) FROM fl WHERE fl.user_id = r.user_id AND fl.ts > r.ts) AS nf
      FROM r WHERE event_type <> 'purchase')
SELECT event_id, user_id, ts,
  round(date_diff('microsecond', ts, nf) / CAST(3600000000 AS DOUBLE), 6) AS hours_to_failure,
  CASE WHEN date_diff('microsecond', ts, nf) / CAST(3600000000 AS DOUBLE) <= 24 THEN 1 ELSE 0 END
    AS failure_within_24h
FROM x""")
def q_failure_horizon(spark, sf):
    """Hours to the next (de-duplicated) failure and the 24 h label, on event tables."""
    r = event_readings(spark, sf)
    fl = r.where(F.col("event_type") == "purchase").select("user_id", "ts")
    rd = r.where(F.col("event_type") != "purchase").select("event_id", "user_id", "ts")
    out = failure_horizon(rd, fl, S)
    return out.withColumn("hours_to_failure", F.round("hours_to_failure", 6))


@register("machine_first_last", LIFECYCLE_CTES + """
SELECT user_id, first(site ORDER BY ts, event_id) AS first_site, first(mtype ORDER BY ts, event_id) AS first_mtype,
       last(age_h ORDER BY ts, event_id) AS last_age_h, last(n_failures ORDER BY ts, event_id) AS last_n_failures
FROM life GROUP BY user_id""")
def q_machine_first_last(spark, sf):
    """E5: type and site at the first row, age and failure total at the last row."""
    return first_last(life(spark, sf), S, first_cols=("site", "mtype"), last_cols=("age_h", "n_failures"))


@register("recent_readings", f"""WITH {READINGS_CTE},
x AS (SELECT user_id, event_id, ts, value, failed,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recent_rank FROM r)
SELECT * FROM x WHERE recent_rank <= 500""")
def q_recent_readings(spark, sf):
    """The 500 latest readings of every machine, failed ones flagged."""
    r = event_readings(spark, sf).select("user_id", "event_id", "ts", "value", "failed")
    return last_n(r, S, 500)


@register("every_4th_row", f"""WITH {READINGS_CTE},
x AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM r)
SELECT user_id, event_id, ts FROM x WHERE i % 4 = 0""")
def q_every_4th_row(spark, sf):
    """Every 4th reading of each machine (a light sample)."""
    return every_nth(event_readings(spark, sf).select("user_id", "event_id", "ts"), S, 4)
