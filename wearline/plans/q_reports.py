"""Fleet-report and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import reports as R
from ..sources.events import READINGS_CTE, event_readings
from ..spec import EVENTS_SPEC
from .catalog import register
from .q_prepare import LIFECYCLE_CTES, life

S = EVENTS_SPEC


def _round(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") and c not in skip else F.col(c)
                       for c, t in df.dtypes])


def _union_sql(parts):
    return "\nUNION ALL\n".join(parts)


# --- D1/D2 ------------------------------------------------------------------
@register("fleet_kpis", LIFECYCLE_CTES + """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_machines, count(DISTINCT site) AS n_sites,
       round(avg(failed), 6) AS failure_rate, round(avg(fail_24h), 6) AS label24_rate,
       round(avg(rul), 6) AS mean_rul
FROM life""")
def q_fleet_kpis(spark, sf):
    """One-pass fleet KPIs."""
    return _round(R.fleet_kpis(life(spark, sf), S))


# --- D3/D4/D12 --------------------------------------------------------------
@register("state_counts", LIFECYCLE_CTES + "\nSELECT state, count(*) AS n FROM life GROUP BY state")
def q_state_counts(spark, sf):
    """D3: value counts of the machine state, descending (B8 alias)."""
    return R.value_counts(life(spark, sf), "state")


@register("site_state_counts", LIFECYCLE_CTES + "\nSELECT site, state, count(*) AS n FROM life GROUP BY site, state")
def q_site_state_counts(spark, sf):
    """Rows per (site, state)."""
    return R.value_counts(life(spark, sf), "site", "state")


@register("failures_per_machine", LIFECYCLE_CTES + """
SELECT user_id, CAST(sum(fail_start) AS BIGINT) AS n_failures FROM life GROUP BY user_id""")
def q_failures_per_machine(spark, sf):
    """Failure episodes per machine."""
    return life(spark, sf).groupBy("user_id").agg(F.sum("fail_start").cast("long").alias("n_failures"))


# --- D5/F2, F3 --------------------------------------------------------------
@register("top_failure_machines", f"""WITH {READINGS_CTE}
SELECT user_id, CAST(sum(failed) AS BIGINT) AS failure_rows FROM r
GROUP BY user_id ORDER BY failure_rows DESC, user_id LIMIT 10""")
def q_top_failure_machines(spark, sf):
    """Top 10 machines by failure rows (ties by id)."""
    return R.top_by_sum(event_readings(spark, sf), "user_id", "failed", 10, "failure_rows")


@register("machine_ids", f"WITH {READINGS_CTE}\nSELECT DISTINCT user_id FROM r ORDER BY user_id")
def q_machine_ids(spark, sf):
    """sorted distinct machine ids."""
    return event_readings(spark, sf).select("user_id").distinct().orderBy("user_id")


# --- D6 ---------------------------------------------------------------------
@register("daily_failures", f"""WITH {READINGS_CTE},
d AS (SELECT CAST(ts AS DATE) AS day, sum(failed) AS s FROM r GROUP BY 1),
b AS (SELECT min(day) AS lo, max(day) AS hi FROM d),
spine AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
          AS day FROM b)
SELECT spine.day, CAST(coalesce(d.s, 0) AS BIGINT) AS failure_rows FROM spine LEFT JOIN d ON spine.day = d.day""")
def q_daily_failures(spark, sf):
    """Failure rows per calendar day, empty days as 0."""
    return R.daily_sum(event_readings(spark, sf), "ts", "failed", "failure_rows")


# --- D7 ---------------------------------------------------------------------
@register("sensor_means_by_state", LIFECYCLE_CTES + "\n" + _union_sql([
    f"SELECT '{c}' AS sensor, state, round(avg({c}), 6) AS mean FROM life GROUP BY state" for c in ("value", "k")]))
def q_sensor_means_by_state(spark, sf):
    """Mean of each sensor per state."""
    return _round(R.means_by(life(spark, sf), "state", ["value", "k"]))


# --- D8/D9 ------------------------------------------------------------------
CORR_COLS = ("value", "k", "degradation", "rul", "failed")


@register("sensor_degradation_corr", LIFECYCLE_CTES + "\n" + _union_sql([
    f"SELECT '{c}' AS a, 'degradation' AS b, round(corr({c}, degradation), 6) AS r FROM life"
    for c in ("value", "k")]))
def q_sensor_degradation_corr(spark, sf):
    """Pearson r of each sensor with the degradation score."""
    return _round(R.correlations(life(spark, sf), [("value", "degradation"), ("k", "degradation")]))


@register("corr_matrix", LIFECYCLE_CTES + "\n" + _union_sql([
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM life" for a in CORR_COLS for b in CORR_COLS]))
def q_corr_matrix(spark, sf):
    """Pearson matrix (long) over sensors, score, RUL and failure flag."""
    return _round(R.corr_matrix(life(spark, sf), CORR_COLS))


# --- D10 --------------------------------------------------------------------
DESCRIBE_COLS = ("value", "k", "rul")


@register("sensor_describe", LIFECYCLE_CTES + "\n" + _union_sql([
    f"""SELECT '{c}' AS sensor, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM life""" for c in DESCRIBE_COLS]))
def q_sensor_describe(spark, sf):
    """describe() with exact quartiles computed by bracket refinement."""
    return _round(R.describe(life(spark, sf), DESCRIBE_COLS))


# --- D11 --------------------------------------------------------------------
FLAGS = ("failed", "fail_start", "maint_edge", "fail_24h")


@register("flag_rates", LIFECYCLE_CTES + "\n" + _union_sql([
    f"SELECT '{c}' AS flag, CAST(sum({c}) AS BIGINT) AS n_set, round(avg({c}), 6) AS rate FROM life" for c in FLAGS]))
def q_flag_rates(spark, sf):
    """Count and share of several 0/1 flags."""
    return _round(R.flag_rates(life(spark, sf), FLAGS))


# --- D13 --------------------------------------------------------------------
@register("box_stats_by_state", LIFECYCLE_CTES + """,
q AS (SELECT state, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
             quantile_cont(value, 0.75) AS q3 FROM life WHERE value IS NOT NULL GROUP BY state)
SELECT q.state, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS whisker_lo,
  round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS whisker_hi,
  count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM life JOIN q ON life.state = q.state WHERE value IS NOT NULL GROUP BY q.state, q1, q2, q3""")
def q_box_stats_by_state(spark, sf):
    """Box statistics of the main sensor per state."""
    return _round(R.box_stats(life(spark, sf), "state", "value"))


# --- D14 --------------------------------------------------------------------
@register("sensor_histogram", f"""WITH {READINGS_CTE}, b AS (SELECT min(value) AS mn, max(value) AS mx FROM r)
SELECT failed, CAST(least(floor((value - mn) / (mx - mn) * 50) + 1, 50) AS BIGINT) AS bin, count(*) AS n
FROM r, b WHERE value IS NOT NULL GROUP BY ALL""")
def q_sensor_histogram(spark, sf):
    """50 equal-width bins of the main sensor, per failure class."""
    return R.histogram(event_readings(spark, sf), "value", 50, by="failed")


# --- scored rows: a deterministic score so metrics are checkable without a model
SCORED_CTE = LIFECYCLE_CTES + """,
s AS (SELECT *, k / CAST(100 AS DOUBLE) AS proba,
             CASE WHEN k / CAST(100 AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS pred,
             CASE WHEN k >= 95 THEN 1 ELSE 0 END AS anomaly,
             CAST(720 AS DOUBLE) * (CAST(1 AS DOUBLE) - k / CAST(100 AS DOUBLE)) AS rul_pred FROM life)"""


def scored(spark, sf):
    p = F.col("k") / F.lit(100.0)
    return life(spark, sf).select(
        "*", p.alias("proba"), F.when(p >= 0.5, 1).otherwise(0).alias("pred"),
        F.when(F.col("k") >= 95, 1).otherwise(0).alias("anomaly"),
        (F.lit(720.0) * (F.lit(1.0) - p)).alias("rul_pred"))


@register("scored_batch_kpis", SCORED_CTE + """
SELECT CAST(sum(pred) AS BIGINT) AS n_positive, round(avg(pred), 6) AS positive_rate,
       round(avg(proba), 6) AS mean_proba FROM s""")
def q_scored_batch_kpis(spark, sf):
    """Predicted positives, positive rate, mean probability."""
    return _round(scored(spark, sf).agg(F.sum("pred").cast("long").alias("n_positive"),
                                        F.avg("pred").alias("positive_rate"), F.avg("proba").alias("mean_proba")))


@register("anomaly_rates", SCORED_CTE + """
SELECT round(avg(CASE WHEN failed = 1 THEN anomaly END), 6) AS rate_on_failed,
       round(avg(CASE WHEN state = 'normal' THEN anomaly END), 6) AS rate_on_normal FROM s""")
def q_anomaly_rates(spark, sf):
    """Anomaly share on failed rows and on normal rows."""
    s = scored(spark, sf)
    return _round(s.agg(F.avg(F.when(F.col("failed") == 1, F.col("anomaly"))).alias("rate_on_failed"),
                        F.avg(F.when(F.col("state") == "normal", F.col("anomaly"))).alias("rate_on_normal")))


@register("class_balance", LIFECYCLE_CTES + "\n" + _union_sql([
    f"SELECT '{c}' AS target, count(*) AS n, CAST(sum({c}) AS BIGINT) AS positives, round(avg({c}), 6) AS share "
    f"FROM life" for c in ("failed", "fail_24h")]))
def q_class_balance(spark, sf):
    """N, positives and share for both classification targets."""
    targets = ("failed", "fail_24h")
    wide = life(spark, sf).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(f"s_{c}") for c in targets],
                               *[F.avg(c).alias(f"a_{c}") for c in targets])  # one pass for both
    parts = ", ".join(f"'{c}', n, s_{c}, a_{c}" for c in targets)
    return _round(wide.select(F.expr(f"stack({len(targets)}, {parts}) AS (target, n, positives, share)")))


BINARY_SQL = SCORED_CTE + """,
c AS (SELECT count(CASE WHEN failed = 1 AND pred = 1 THEN 1 END) AS tp,
             count(CASE WHEN failed = 0 AND pred = 1 THEN 1 END) AS fp,
             count(CASE WHEN failed = 1 AND pred = 0 THEN 1 END) AS fn,
             count(CASE WHEN failed = 0 AND pred = 0 THEN 1 END) AS tn FROM s)"""


@register("binary_metrics", BINARY_SQL + """
SELECT tp, fp, fn, tn,
  round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1_score
FROM c""")
def q_binary_metrics(spark, sf):
    """Accuracy, precision, recall, F1 of a thresholded score."""
    return _round(M.binary_metrics(scored(spark, sf), "failed", "pred"))


@register("roc_auc", SCORED_CTE + """,
g AS (SELECT proba, CAST(sum(failed) AS DOUBLE) AS pos, CAST(sum(1 - failed) AS DOUBLE) AS neg FROM s GROUP BY proba),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS neg_below FROM g),
t AS (SELECT sum(pos) AS p, sum(neg) AS n, sum(pos * (neg_below + 0.5 * neg)) AS num FROM c)
SELECT CASE WHEN p = 0 OR n = 0 THEN 0.0 ELSE round(num / (p * n), 6) END AS auc_roc FROM t""")
def q_roc_auc(spark, sf):
    """Exact tie-aware ROC AUC."""
    return _round(M.roc_auc(scored(spark, sf), "failed", "proba"))


@register("confusion_matrix", BINARY_SQL + """
SELECT 0 AS label, 0 AS pred, tn AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c""")
def q_confusion_matrix(spark, sf):
    """Confusion matrix, all four label pairs."""
    return M.confusion_long(scored(spark, sf), "failed", "pred")


@register("class_report", BINARY_SQL + """,
v AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn
      FROM c),
x AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1,
             CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1,
             CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0,
             CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0,
             tp + fn AS s1, tn + fp AS s0, tp + fp + fn + tn AS n FROM v),
y AS (SELECT *, CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1,
             CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
             CASE WHEN n = 0 THEN 0 ELSE (tp + tn) / n END AS acc FROM x)
SELECT '0' AS class, round(p0, 3) AS precision, round(r0, 3) AS recall, round(f0, 3) AS f1_score,
       round(s0, 3) AS support FROM y
UNION ALL SELECT '1', round(p1, 3), round(r1, 3), round(f1, 3), round(s1, 3) FROM y
UNION ALL SELECT 'accuracy', round(acc, 3), round(acc, 3), round(acc, 3), round(acc, 3) FROM y
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 3), round((r0 + r1) / 2, 3), round((f0 + f1) / 2, 3),
                 round(n, 3) FROM y
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 3), round((r0 * s0 + r1 * s1) / n, 3),
                 round((f0 * s0 + f1 * s1) / n, 3), round(n, 3) FROM y""")
def q_class_report(spark, sf):
    """Classification report table, rounded to 3."""
    return M.class_report(scored(spark, sf), "failed", "pred")


@register("regression_metrics", SCORED_CTE + """
SELECT round(avg(abs(rul - rul_pred)), 6) AS mae, round(sqrt(avg((rul - rul_pred) * (rul - rul_pred))), 6) AS rmse,
       round(1 - sum((rul - rul_pred) * (rul - rul_pred)) / (count(*) * var_pop(rul)), 6) AS r2 FROM s""")
def q_regression_metrics(spark, sf):
    """MAE, RMSE, R2 of a RUL prediction."""
    return _round(M.regression_metrics(scored(spark, sf), "rul", "rul_pred"))


METRIC_NAMES = ("accuracy", "precision", "recall", "f1_score")


@register("metrics_table", SCORED_CTE + """,
p AS (SELECT 'failed' AS task, failed AS y, pred FROM s UNION ALL SELECT 'fail_24h', fail_24h, pred FROM s),
c AS (SELECT task, count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp,
             count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) AS fp,
             count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) AS fn,
             count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn FROM p GROUP BY task)
SELECT task, 'k_threshold' AS model,
  round(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1_score
FROM c""")
def q_metrics_table(spark, sf):
    """Long metrics of two tasks pivoted to one row per (task, model)."""
    counts = M.binary_counts_of(scored(spark, sf), ("failed", "fail_24h"), "pred")
    long = M.long_metrics(M.with_rates(counts).withColumn("model", F.lit("k_threshold")), {"task": F.col("task"), "model": F.col("model")}, METRIC_NAMES)
    return _round(M.metrics_table(long, METRIC_NAMES))


@register("probability_histogram", SCORED_CTE + """,
b AS (SELECT min(proba) AS mn, max(proba) AS mx FROM s)
SELECT upper(CASE WHEN proba >= 0.8 THEN 'critique' WHEN proba >= 0.5 THEN 'élevé' WHEN proba >= 0.3 THEN 'moyen'
             ELSE 'faible' END) AS risque,
       CAST(least(floor((proba - mn) / (mx - mn) * 20) + 1, 20) AS BIGINT) AS bin, count(*) AS n
FROM s, b WHERE proba IS NOT NULL GROUP BY ALL""")
def q_probability_histogram(spark, sf):
    """D14 (batch form): 20 equal-width bins of the probability, per risk level."""
    from ..functions.scalar import proba_risk_upper
    s = scored(spark, sf).withColumn("risque", proba_risk_upper("proba"))
    return R.histogram(s, "proba", 20, by="risque")
