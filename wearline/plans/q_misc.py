"""Preparation-job queries (J1, C1, flagship), row rules (B*, I*), splits (H*), scaling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..functions.validation import parse_requests, validate_requests
from ..operators import sampling as H
from ..operators.encode import category_maps, encode
from ..operators.scaling import apply_scaler, fit_scaler
from ..operators.series import attach_chunk_widths, lifecycle, rolling_features
from ..sources.events import READINGS_CTE, event_readings
from ..spec import EVENTS_SPEC, MACHINE_TYPES, SITES
from .catalog import register
from .q_prepare import LIFECYCLE_CTES, life

S = EVENTS_SPEC
MD5 = "md5('42|' || CAST(event_id AS VARCHAR))"

# --- J1 / C1 ----------------------------------------------------------------
CODES_CTE = """codes AS (SELECT feature, category,
      CAST(dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT 'site' AS feature, site AS category FROM r
          UNION SELECT DISTINCT 'mtype', mtype FROM r))"""


@register("category_codes", f"WITH {READINGS_CTE}, {CODES_CTE}\nSELECT * FROM codes")
def q_category_codes(spark, sf):
    """Category -> code in codepoint order, one long table for both columns."""
    return category_maps(event_readings(spark, sf), ["site", "mtype"])


ENCODE_MAP = {"site": "site_code", "mtype": "mtype_code"}


@register("encoded_readings", f"""WITH {READINGS_CTE}, {CODES_CTE}
SELECT r.event_id, r.user_id, coalesce(a.code, 0) AS site_code, coalesce(b.code, 0) AS mtype_code FROM r
LEFT JOIN codes a ON a.feature = 'site' AND a.category = r.site
LEFT JOIN codes b ON b.feature = 'mtype' AND b.category = r.mtype""")
def q_encoded_readings(spark, sf):
    """Size-checked broadcast lookup of the codes, unknown -> 0."""
    r = event_readings(spark, sf)
    maps = category_maps(r, list(ENCODE_MAP))
    return encode(r, maps, ENCODE_MAP).select("event_id", "user_id", "site_code", "mtype_code")


# --- flagship: the prepared table ----------------------------------------------
PREPARED_COLS = ("user_id", "event_id", "ts", "value", "k", "failed", "site", "mtype", "site_code", "mtype_code",
                 "fail_start", "n_failures", "maint_edge", "n_maint", "since_maint_h", "age_h", "state", "fail_24h",
                 "degradation")
ROLL = ("value_mean_24h", "value_std_24h", "k_mean_24h", "k_std_24h")

PREPARED_CTES = LIFECYCLE_CTES + f""", {CODES_CTE},
prep AS (SELECT life.*, coalesce(a.code, 0) AS site_code, coalesce(b.code, 0) AS mtype_code,
    avg(value) OVER w AS value_mean_24h, coalesce(stddev_samp(value) OVER w, 0) AS value_std_24h,
    avg(k) OVER w AS k_mean_24h, coalesce(stddev_samp(k) OVER w, 0) AS k_std_24h
  FROM life
  LEFT JOIN codes a ON a.feature = 'site' AND a.category = life.site
  LEFT JOIN codes b ON b.feature = 'mtype' AND b.category = life.mtype
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


def prepared(spark, sf):
    """The whole preparation job: lifecycle labels, rolling features, codes."""
    # the lifecycle keeps its (machine, chunk) partitioning for the rolling step
    lf = lifecycle(attach_chunk_widths(event_readings(spark, sf), S), S, keep_chunk=True)
    rolled = rolling_features(lf, S)
    # classes come from the source scan (same rows), not from the derived frame
    maps = category_maps(event_readings(spark, sf), list(ENCODE_MAP))
    return encode(rolled, maps, ENCODE_MAP)


@register("prepared_readings", PREPARED_CTES + "\nSELECT " + ", ".join(PREPARED_COLS) + ", "
          + ", ".join(f"round({c}, 6) AS {c}" for c in ROLL + ("rul",)) + " FROM prep")
def q_prepared_readings(spark, sf):
    """Flagship: scan -> lifecycle (E3, E4, E8, C3, B1, B9, B12) -> rolling (E1, E2) -> codes."""
    return prepared(spark, sf).select(*PREPARED_COLS, *[F.round(c, 6).alias(c) for c in ROLL + ("rul",)])


FEATURES = S.features


@register("feature_rows", PREPARED_CTES + f"""
SELECT event_id, {', '.join(FEATURES)}, failed, fail_24h, CASE WHEN event_id % 19 = 0 THEN 0 ELSE round(rul, 6) END AS rul FROM prep
WHERE event_id % 13 <> 0 AND event_id % 17 <> 0""")
def q_feature_rows(spark, sf):
    """Drop rows with a null feature, fill the rest, fixed feature order. The table has no
    nulls, so two features and the target are first emptied in some rows."""
    p = prepared(spark, sf).withColumns({c: F.when(F.col("event_id") % n != 0, F.col(c)) for c, n in (("value", 13), ("k", 17), ("rul", 19))})
    p = p.na.drop(subset=list(FEATURES)).na.fill(0, ["rul"])
    return p.select("event_id", *FEATURES, "failed", "fail_24h", F.round("rul", 6).alias("rul"))


@register("normal_rows", LIFECYCLE_CTES + "\nSELECT event_id, user_id FROM life WHERE failed = 0 AND state = 'normal'")
def q_normal_rows(spark, sf):
    """Equality filters (not failed, state normal)."""
    return life(spark, sf).where((F.col("failed") == 0) & (F.col("state") == "normal")).select("event_id", "user_id")


@register("preview", f"WITH {READINGS_CTE}\nSELECT * FROM r ORDER BY user_id, ts, event_id LIMIT 5")
def q_preview(spark, sf):
    """The first rows in key order."""
    return event_readings(spark, sf).orderBy("user_id", "ts", "event_id").limit(5)


@register("machine_codes", f"""WITH {READINGS_CTE}
SELECT DISTINCT user_id, site, site || '-M' ||
  CASE WHEN user_id < 10 THEN '0' ELSE '' END || CAST(user_id AS VARCHAR) AS machine_code FROM r""")
def q_machine_codes(spark, sf):
    """Zero-padded machine code ``<site>-Mnn``."""
    r = event_readings(spark, sf)
    return r.select("user_id", "site", X.machine_code("site", F.col("user_id")).alias("machine_code")).distinct()


# --- B7 / I12: request validation ---------------------------------------------
TYPES_LIST = MACHINE_TYPES + ("Inconnu",)


def _requests(spark, sf):
    r = event_readings(spark, sf)
    mtype = F.element_at(F.array(*[F.lit(t) for t in TYPES_LIST]), (F.col("event_id") % 5 + 1).cast("int"))
    site = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(
        F.element_at(F.array(*[F.lit(s) for s in SITES]), (F.col("event_id") % 5 + 1).cast("int")))
    body = F.to_json(F.struct(
        F.col("value").alias("temperature_C"), (F.col("k") / 4.0).alias("vibration_mm_s"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("k")).alias("courant_A"),
        (F.col("k") / 10.0).alias("pression_bar"), (F.col("value") * 10.0).alias("vitesse_tr_min"),
        (F.col("user_id") * 1000).alias("age_machine_h"), (F.col("event_id") * 2).alias("h_depuis_maintenance"),
        mtype.alias("type_machine"), site.alias("usine_id")))
    return r.select("event_id", body.alias("body"))


# Every range, choice and default is written out here, apart from the code's own constants.
VALIDATION_SQL = f"""WITH {READINGS_CTE},
q AS (SELECT event_id, value AS temperature_C, k / CAST(4 AS DOUBLE) AS vibration_mm_s,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE k END AS courant_A, k / CAST(10 AS DOUBLE) AS pression_bar,
        value * CAST(10 AS DOUBLE) AS vitesse_tr_min, user_id * 1000 AS age_machine_h, event_id * 2 AS h_depuis_maintenance,
        list_extract(['CNC-Fraisage', 'CNC-Tournage', 'Découpe-Laser', 'Centre-Usinage', 'Inconnu'], CAST(event_id % 5 + 1 AS INTEGER)) AS type_machine,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE list_extract(['USN-FR-01', 'USN-FR-02', 'USN-FR-03', 'USN-ES-01', 'USN-ES-02'],
          CAST(event_id % 5 + 1 AS INTEGER)) END AS usine_id FROM r),
v AS (SELECT *, list_filter([
  CASE WHEN temperature_C IS NULL THEN 'temperature_C: required' END,
  CASE WHEN temperature_C < -20.0 OR temperature_C > 300.0 THEN 'temperature_C: outside [-20.0, 300.0]' END,
  CASE WHEN vibration_mm_s IS NULL THEN 'vibration_mm_s: required' END,
  CASE WHEN vibration_mm_s < 0.0 OR vibration_mm_s > 20.0 THEN 'vibration_mm_s: outside [0.0, 20.0]' END,
  CASE WHEN courant_A IS NULL THEN 'courant_A: required' END,
  CASE WHEN courant_A < 0.0 OR courant_A > 100.0 THEN 'courant_A: outside [0.0, 100.0]' END,
  CASE WHEN pression_bar IS NULL THEN 'pression_bar: required' END,
  CASE WHEN pression_bar < 0.0 OR pression_bar > 20.0 THEN 'pression_bar: outside [0.0, 20.0]' END,
  CASE WHEN vitesse_tr_min IS NULL THEN 'vitesse_tr_min: required' END,
  CASE WHEN vitesse_tr_min < 0.0 OR vitesse_tr_min > 3000.0 THEN 'vitesse_tr_min: outside [0.0, 3000.0]' END,
  CASE WHEN age_machine_h IS NULL THEN 'age_machine_h: required' END,
  CASE WHEN age_machine_h < 0 OR age_machine_h > 200000 THEN 'age_machine_h: outside [0, 200000]' END,
  CASE WHEN h_depuis_maintenance IS NULL THEN 'h_depuis_maintenance: required' END,
  CASE WHEN h_depuis_maintenance < 0 OR h_depuis_maintenance > 10000 THEN 'h_depuis_maintenance: outside [0, 10000]' END,
  CASE WHEN type_machine NOT IN ('CNC-Fraisage', 'CNC-Tournage', 'Découpe-Laser', 'Centre-Usinage') THEN 'type_machine: not an accepted value' END,
  CASE WHEN usine_id NOT IN ('USN-FR-01', 'USN-FR-02', 'USN-FR-03', 'USN-ES-01', 'USN-ES-02') THEN 'usine_id: not an accepted value' END], lambda x: x IS NOT NULL) AS errs FROM q)
SELECT event_id, CAST(len(errs) AS INTEGER) AS n_errors, array_to_string(errs, '; ') AS errors,
       coalesce(type_machine, 'CNC-Fraisage') AS type_machine, coalesce(usine_id, 'USN-FR-01') AS usine_id FROM v"""


@register("request_validation", VALIDATION_SQL)
def q_request_validation(spark, sf):
    """I12 + B7: JSON bodies -> typed fields -> range/list checks -> error list; defaults applied."""
    v = validate_requests(parse_requests(_requests(spark, sf), "body"))
    return v.select("event_id", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors"),
                    "type_machine", "usine_id")


# --- I1-I11: scoring rules -----------------------------------------------------
TWO_PI_60 = 2.0 * math.pi / 60.0


@register("scoring_rules", LIFECYCLE_CTES + f""",
s AS (SELECT *, k / CAST(100 AS DOUBLE) AS proba, -(0.3 + k / CAST(250 AS DOUBLE)) AS iso_score,
             CAST(720 AS DOUBLE) * (CAST(1 AS DOUBLE) - k / CAST(100 AS DOUBLE)) - 100 AS rul_raw FROM life),
t AS (SELECT *, greatest(0, rul_raw) AS rul_pred,
             least(greatest((-iso_score - 0.3) / 0.4, 0), 1) AS anom, k >= 90 AS is_anom FROM s)
SELECT event_id,
  round(proba, 4) AS probability,
  CASE WHEN proba >= 0.8 THEN 'critique' WHEN proba >= 0.5 THEN 'élevé' WHEN proba >= 0.3 THEN 'moyen'
       ELSE 'faible' END AS risk_level,
  CASE WHEN proba >= 0.8 THEN 'ARRÊT IMMÉDIAT recommandé. Intervention urgente requise.' WHEN proba >= 0.5 THEN 'Planifier une maintenance préventive dans les prochaines heures.'
       WHEN proba >= 0.3 THEN 'Surveillance renforcée. Vérifier les paramètres machine.' ELSE 'Machine en fonctionnement normal. Aucune action requise.' END AS recommendation,
  upper(CASE WHEN proba >= 0.8 THEN 'critique' WHEN proba >= 0.5 THEN 'élevé' WHEN proba >= 0.3 THEN 'moyen'
       ELSE 'faible' END) AS risque,
  round(rul_pred, 1) AS rul_estime_h,
  CASE WHEN rul_pred < 6 THEN 'critique' WHEN rul_pred < 12 THEN 'élevé' WHEN rul_pred < 24 THEN 'moyen'
       ELSE 'faible' END AS rul_level,
  CASE WHEN rul_pred < 6 THEN 'ARRÊT IMMÉDIAT. Maintenance urgente à planifier.' WHEN rul_pred < 12 THEN 'Maintenance à prévoir dans les prochaines heures.'
       WHEN rul_pred < 24 THEN 'Surveiller de près. Maintenance sous 24 h.' ELSE 'Machine en état normal. Prochaine maintenance planifiée.' END AS rul_recommendation,
  round(anom, 4) AS anomaly_score,
  CASE WHEN is_anom AND anom > 0.7 THEN 'anomalie' WHEN is_anom THEN 'suspect' ELSE 'normal' END AS anomaly_level,
  CASE WHEN value - 50 > 0 THEN 'hausse_risque' ELSE 'baisse_risque' END AS direction,
  array_to_string(list_transform(string_split(replace(state, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')
    AS state_label,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts_parsed,
  round((k + 305) - (value / 10 + 300), 6) AS temp_difference_k,
  round(value + 300 - 273.15, 6) AS temp_c,
  round(k * value * CAST({TWO_PI_60!r} AS DOUBLE), 6) AS power_w,
  round(CASE WHEN value = 0 THEN NULL ELSE k / value END, 6) AS torque_speed_ratio
FROM t""")
def q_scoring_rules(spark, sf):
    """Probability and RUL risk levels with advice, anomaly level, rounding,
    direction, labels, timestamp text and derived physical quantities."""
    lf = life(spark, sf)
    p = F.col("k") / F.lit(100.0)
    iso = -(F.lit(0.3) + F.col("k") / F.lit(250.0))
    rul = X.rul_floor(F.lit(720.0) * (F.lit(1.0) - p) - F.lit(100))
    anom = X.anomaly_normalized(iso)
    is_anom = F.col("k") >= 90
    return lf.select(
        "event_id", F.round(p, 4).alias("probability"), X.proba_risk(p).alias("risk_level"),
        X.proba_advice(p).alias("recommendation"), X.proba_risk_upper(p).alias("risque"),
        F.round(rul, 1).alias("rul_estime_h"), X.rul_risk(rul).alias("rul_level"),
        X.rul_advice(rul).alias("rul_recommendation"), F.round(anom, 4).alias("anomaly_score"),
        X.anomaly_level(is_anom, anom).alias("anomaly_level"), X.direction(F.col("value") - 50).alias("direction"),
        X.title_label("state").alias("state_label"), X.format_ts("ts").alias("ts_text"), X.parse_ts(X.format_ts("ts")).alias("ts_parsed"),
        F.round(X.temperature_difference(F.col("k") + 305, F.col("value") / 10 + 300), 6).alias("temp_difference_k"),
        F.round(X.kelvin_to_celsius(F.col("value") + 300), 6).alias("temp_c"),
        F.round(X.mechanical_power_w("k", "value"), 6).alias("power_w"),
        F.round(X.torque_speed_ratio("k", "value"), 6).alias("torque_speed_ratio"))


# --- H1-H6 --------------------------------------------------------------------
@register("stratified_split", f"""WITH {READINGS_CTE},
x AS (SELECT event_id, failed, row_number() OVER (PARTITION BY failed ORDER BY {MD5}) AS rn,
             count(*) OVER (PARTITION BY failed) AS n FROM r)
SELECT event_id, failed, rn <= round(0.2 * n) AS is_test FROM x""")
def q_stratified_split(spark, sf):
    """H1: stratified 80/20 split by hash order."""
    return H.stratified_split(event_readings(spark, sf).select("event_id", "failed"), "failed", "event_id")


@register("plain_split", f"""WITH {READINGS_CTE},
x AS (SELECT event_id, row_number() OVER (ORDER BY {MD5}) AS rn, count(*) OVER () AS n FROM r)
SELECT event_id, rn <= ceil(0.2 * n) AS is_test FROM x""")
def q_plain_split(spark, sf):
    """H2: plain 80/20 split, test = ceil(0.2 n) rows."""
    return H.plain_split(event_readings(spark, sf).select("event_id"), "event_id")


BAL_CTE = f"""x AS (SELECT event_id, failed, row_number() OVER (PARTITION BY failed ORDER BY {MD5}) AS rn,
             sum(failed) OVER () AS npos FROM r),
bal AS (SELECT event_id, failed FROM x WHERE failed = 1 OR rn <= npos)"""


@register("balanced_sample", f"WITH {READINGS_CTE}, {BAL_CTE}\nSELECT * FROM bal")
def q_balanced_sample(spark, sf):
    """H3: all positives and as many negatives (hash order)."""
    return H.balance(event_readings(spark, sf).select("event_id", "failed"), "failed", "event_id")


@register("capped_sample", f"""WITH {READINGS_CTE},
x AS (SELECT event_id, row_number() OVER (ORDER BY {MD5}) AS rn FROM r)
SELECT event_id FROM x WHERE rn <= 10000""")
def q_capped_sample(spark, sf):
    """H4: the SVM's cap of 10,000 rows, only when there are more."""
    return H.cap_rows(event_readings(spark, sf).select("event_id"), "event_id", 10_000)


@register("demo_export", f"""WITH {READINGS_CTE}
(SELECT event_id, failed, value, k FROM r WHERE failed = 1 ORDER BY {MD5} LIMIT 50)
UNION ALL
(SELECT event_id, failed, value, k FROM r WHERE failed = 0 ORDER BY {MD5} LIMIT 50)""")
def q_demo_export(spark, sf):
    """H5 + G1: up to 50 failed and 50 normal rows, stacked."""
    return H.demo_export(event_readings(spark, sf).select("event_id", "failed", "value", "k"), "failed", "event_id")


@register("cv_folds", f"""WITH {READINGS_CTE}, {BAL_CTE},
c AS (SELECT failed, count(*) AS n FROM bal GROUP BY failed),
o AS (SELECT failed, n, coalesce(sum(n) OVER (ORDER BY failed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS off FROM c),
a AS (SELECT failed,
        floor((off + n - 1 - 0) / 5) - floor((off - 1 - 0) / 5) AS a0,
        floor((off + n - 1 - 1) / 5) - floor((off - 1 - 1) / 5) AS a1,
        floor((off + n - 1 - 2) / 5) - floor((off - 1 - 2) / 5) AS a2,
        floor((off + n - 1 - 3) / 5) - floor((off - 1 - 3) / 5) AS a3 FROM o),
y AS (SELECT event_id, failed, row_number() OVER (PARTITION BY failed ORDER BY {MD5}) AS rn FROM bal)
SELECT event_id, y.failed,
  CAST((rn > a0)::INTEGER + (rn > a0 + a1)::INTEGER + (rn > a0 + a1 + a2)::INTEGER
       + (rn > a0 + a1 + a2 + a3)::INTEGER AS INTEGER) AS fold
FROM y JOIN a ON y.failed = a.failed""")
def q_cv_folds(spark, sf):
    """H6: 5 unshuffled stratified folds of the balanced sample."""
    bal = H.balance(event_readings(spark, sf).select("event_id", "failed"), "failed", "event_id")
    return H.stratified_folds(bal, "failed", "event_id", 5)


# --- J2 -----------------------------------------------------------------------
@register("scaled_features", f"""WITH {READINGS_CTE}
SELECT event_id,
  round((value - avg(value) OVER ()) / CASE WHEN stddev_pop(value) OVER () = 0 THEN 1 ELSE stddev_pop(value) OVER () END,
        6) AS value_z,
  round((k - avg(k) OVER ()) / CASE WHEN stddev_pop(k) OVER () = 0 THEN 1 ELSE stddev_pop(k) OVER () END, 6) AS k_z
FROM r""")
def q_scaled_features(spark, sf):
    """Standard scaling with population std (zero std -> 1)."""
    r = event_readings(spark, sf)
    st = fit_scaler(r, ["value", "k"])
    out = apply_scaler(r, st, "_z")
    return out.select("event_id", F.round("value_z", 6).alias("value_z"), F.round("k_z", 6).alias("k_z"))
