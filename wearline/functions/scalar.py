"""Row-level expressions: labels, states, risk levels, rounding, id formats.

All of them are built-in Column expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import RUL_CAP_HOURS

# ---------------------------------------------------------------------------
# Fixed values (thresholds, labels and advice texts of the scoring rules).
# ---------------------------------------------------------------------------
PROBA_LEVELS = (  # (lower bound, level, advice), checked top-down
    (0.8, "critique", "ARRÊT IMMÉDIAT recommandé. Intervention urgente requise."),
    (0.5, "élevé", "Planifier une maintenance préventive dans les prochaines heures."),
    (0.3, "moyen", "Surveillance renforcée. Vérifier les paramètres machine."),
)
PROBA_DEFAULT = ("faible", "Machine en fonctionnement normal. Aucune action requise.")

RUL_LEVELS = (  # (upper bound exclusive, level, advice)
    (6.0, "critique", "ARRÊT IMMÉDIAT. Maintenance urgente à planifier."),
    (12.0, "élevé", "Maintenance à prévoir dans les prochaines heures."),
    (24.0, "moyen", "Surveiller de près. Maintenance sous 24 h."),
)
RUL_DEFAULT = ("faible", "Machine en état normal. Prochaine maintenance planifiée.")

ANOMALY_LEVELS = {
    "anomalie": "Comportement capteur très inhabituel. Vérifier la machine immédiatement.",
    "suspect": "Comportement légèrement atypique. Surveillance renforcée recommandée.",
    "normal": "Comportement capteur dans les normes habituelles.",
}
ANOMALY_SHIFT, ANOMALY_SPAN, ANOMALY_HIGH = 0.3, 0.4, 0.7

STATE_CRITICAL_H, STATE_AT_RISK_H = 48.0, 168.0
LABEL_HORIZON_H = 24.0
DEGRADATION_MAINT_SCALE, DEGRADATION_MAINT_CAP = 4000.0, 0.25
DIRECTION_UP, DIRECTION_DOWN = "hausse_risque", "baisse_risque"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- labels and states (B1, B9, B12, B13) ----------------------------------

def label_within(rul, hours: float = LABEL_HORIZON_H) -> Column:
    """B1: 1 when RUL <= hours; a null RUL gives 0 (a NaN comparison is false)."""
    return F.coalesce((_c(rul) <= F.lit(hours)).cast("int"), F.lit(0))


def machine_state(failed, rul) -> Column:
    """Failed -> en_panne; RUL < 48 critique; < 168 a_risque; else normal."""
    return (F.when(_c(failed) == 1, F.lit("en_panne"))
            .when(_c(rul) < STATE_CRITICAL_H, F.lit("critique"))
            .when(_c(rul) < STATE_AT_RISK_H, F.lit("a_risque"))
            .otherwise(F.lit("normal")))


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def degradation_score(rul, since_maint, cap: float = RUL_CAP_HOURS, digits: int | None = 4) -> Column:
    """Noise-free degradation score from RUL and hours since maintenance."""
    r = clip(F.lit(1.0) - _c(rul) / F.lit(cap), 0.0, 1.0)
    m = clip(_c(since_maint) / F.lit(DEGRADATION_MAINT_SCALE), 0.0, DEGRADATION_MAINT_CAP)
    s = clip(r + m * (F.lit(1.0) - r), 0.0, 1.0)
    return F.round(s, digits) if digits is not None else s


def machine_code(site, number) -> Column:
    """``<site>-Mnn`` with a two-digit zero-padded number."""
    return F.format_string("%s-M%02d", _c(site), _c(number).cast("int"))


# --- risk levels (I1-I7) ---------------------------------------------------

def proba_risk(p) -> Column:
    """Probability -> level."""
    e = None
    for lo, lvl, _ in PROBA_LEVELS:
        e = (F.when(_c(p) >= lo, F.lit(lvl)) if e is None else e.when(_c(p) >= lo, F.lit(lvl)))
    return e.otherwise(F.lit(PROBA_DEFAULT[0]))


def proba_advice(p) -> Column:
    e = None
    for lo, _, adv in PROBA_LEVELS:
        e = (F.when(_c(p) >= lo, F.lit(adv)) if e is None else e.when(_c(p) >= lo, F.lit(adv)))
    return e.otherwise(F.lit(PROBA_DEFAULT[1]))


def proba_risk_upper(p) -> Column:
    """Batch label, upper case."""
    return F.upper(proba_risk(p))


def rul_floor(x) -> Column:
    """A predicted RUL is never negative."""
    return F.greatest(F.lit(0.0), _c(x).cast("double"))


def rul_risk(rul) -> Column:
    """RUL (hours) -> level."""
    e = None
    for hi, lvl, _ in RUL_LEVELS:
        e = (F.when(_c(rul) < hi, F.lit(lvl)) if e is None else e.when(_c(rul) < hi, F.lit(lvl)))
    return e.otherwise(F.lit(RUL_DEFAULT[0]))


def rul_advice(rul) -> Column:
    e = None
    for hi, _, adv in RUL_LEVELS:
        e = (F.when(_c(rul) < hi, F.lit(adv)) if e is None else e.when(_c(rul) < hi, F.lit(adv)))
    return e.otherwise(F.lit(RUL_DEFAULT[1]))


def anomaly_normalized(score) -> Column:
    """I4: raw isolation score (negative, lower = stranger) -> [0, 1]."""
    return clip((-_c(score) - F.lit(ANOMALY_SHIFT)) / F.lit(ANOMALY_SPAN), 0.0, 1.0)


def anomaly_level(is_anomaly, normalized) -> Column:
    return (F.when(_c(is_anomaly) & (_c(normalized) > ANOMALY_HIGH), F.lit("anomalie"))
            .when(_c(is_anomaly), F.lit("suspect"))
            .otherwise(F.lit("normal")))


def anomaly_advice(level) -> Column:
    e = None
    for lvl, adv in ANOMALY_LEVELS.items():
        e = (F.when(_c(level) == lvl, F.lit(adv)) if e is None else e.when(_c(level) == lvl, F.lit(adv)))
    return e


def direction(contribution) -> Column:
    """Sign of a contribution."""
    return F.when(_c(contribution) > 0, F.lit(DIRECTION_UP)).otherwise(F.lit(DIRECTION_DOWN))


# --- names and text (I8, I9, I10) ------------------------------------------

def sensor_prefix(name: str) -> str:
    """I8 at plan time: text before the first underscore."""
    return name.split("_")[0]


def title_label(c) -> Column:
    """``_`` -> space, title case."""
    return F.initcap(F.regexp_replace(_c(c), "_", " "))


TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def format_ts(c) -> Column:
    """Timestamp -> text."""
    return F.date_format(_c(c), TS_FORMAT)


def parse_ts(c) -> Column:
    """Text -> TIMESTAMP_NTZ."""
    return F.to_timestamp_ntz(_c(c), F.lit(TS_FORMAT))


# --- derived physical quantities (I11) -------------------------------------

def kelvin_to_celsius(c) -> Column:
    return _c(c) - F.lit(273.15)


def temperature_difference(process_k, air_k) -> Column:
    return _c(process_k) - _c(air_k)


def mechanical_power_w(torque_nm, rpm) -> Column:
    """Power = torque x angular speed (rpm x 2 pi / 60)."""
    return _c(torque_nm) * _c(rpm) * F.lit(2.0 * math.pi / 60.0)


def torque_speed_ratio(torque_nm, rpm) -> Column:
    return F.try_divide(_c(torque_nm), _c(rpm))
