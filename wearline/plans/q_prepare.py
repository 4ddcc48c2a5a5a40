"""Preparation queries: rolling features, lifecycle labels, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.series import attach_chunk_widths, lifecycle, rolling_features
from ..sources.events import READINGS_CTE, event_readings
from ..spec import EVENTS_SPEC
from .catalog import register

S = EVENTS_SPEC


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


ROLLING_SQL = f"""WITH {READINGS_CTE}
SELECT user_id, event_id, ts,
  round(avg(value) OVER w, 6) AS value_mean_24h,
  round(coalesce(stddev_samp(value) OVER w, 0), 6) AS value_std_24h,
  round(avg(k) OVER w, 6) AS k_mean_24h,
  round(coalesce(stddev_samp(k) OVER w, 0), 6) AS k_std_24h
FROM r
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


@register("rolling_features", ROLLING_SQL)
def q_rolling_features(spark, sf):
    """E1, E2 (F1 order): 24-row mean and sample std of each sensor per machine."""
    out = rolling_features(event_readings(spark, sf), S)
    return out.select("user_id", "event_id", "ts",
                      *_r6("value_mean_24h", "value_std_24h", "k_mean_24h", "k_std_24h"))


LIFECYCLE_CTES = f"""WITH {READINGS_CTE},
la AS (SELECT *, lag(failed) OVER w AS pf, row_number() OVER w - 1 AS idx
      FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
lb AS (SELECT *, CASE WHEN failed = 1 AND coalesce(pf, 0) = 0 THEN 1 ELSE 0 END AS fail_start,
                CASE WHEN failed = 0 AND pf = 1 THEN 1 ELSE 0 END AS maint_edge FROM la),
lc AS (SELECT *, sum(fail_start) OVER w1 AS n_failures, sum(maint_edge) OVER w1 AS n_maint,
             max(CASE WHEN maint_edge = 1 THEN idx END) OVER w1 AS last_reset,
             min(CASE WHEN fail_start = 1 THEN ts END) OVER w2 AS next_fail_ts
      FROM lb WINDOW
        w1 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        w2 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ld AS (SELECT *,
        least(coalesce(date_diff('microsecond', ts, next_fail_ts) / CAST(3600000000 AS DOUBLE),
                       CAST(720 AS DOUBLE)), CAST(720 AS DOUBLE)) AS rul,
        CAST(CASE WHEN last_reset IS NULL THEN idx + 1 ELSE idx - last_reset + 1 END AS BIGINT) AS since_maint_h
      FROM lc),
le AS (SELECT *,
        least(greatest(CAST(1 AS DOUBLE) - rul / CAST(720 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS rr,
        least(greatest(since_maint_h / CAST(4000 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(0.25 AS DOUBLE)) AS mm
      FROM ld),
life AS (SELECT user_id, event_id, ts, event_type, value, k, failed, site, mtype, fail_start,
        CAST(n_failures AS BIGINT) AS n_failures, maint_edge, CAST(n_maint AS BIGINT) AS n_maint,
        since_maint_h, CAST(idx AS BIGINT) AS age_h, next_fail_ts, rul,
        CASE WHEN failed = 1 THEN 'en_panne' WHEN rul < 48 THEN 'critique'
             WHEN rul < 168 THEN 'a_risque' ELSE 'normal' END AS state,
        CASE WHEN rul <= 24 THEN 1 ELSE 0 END AS fail_24h,
        round(least(greatest(rr + mm * (CAST(1 AS DOUBLE) - rr), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)), 4)
          AS degradation
      FROM le)"""

LIFECYCLE_COLS = ("user_id", "event_id", "ts", "failed", "fail_start", "n_failures", "maint_edge",
                  "n_maint", "since_maint_h", "age_h", "next_fail_ts", "state", "fail_24h", "degradation")


def life(spark, sf):
    """Readings with lifecycle columns."""
    return lifecycle(attach_chunk_widths(event_readings(spark, sf), S), S)


@register("machine_lifecycle", LIFECYCLE_CTES + "\nSELECT " + ", ".join(LIFECYCLE_COLS)
          + ", round(rul, 6) AS rul FROM life")
def q_machine_lifecycle(spark, sf):
    """E3 episode starts and running failure count; E4 maintenance edges, counter and
    running count; E8 age from row index; C3 hours to the next failure start; B9
    state; B1 24 h label; B12 degradation score."""
    return life(spark, sf).select(*LIFECYCLE_COLS, F.round("rul", 6).alias("rul"))
