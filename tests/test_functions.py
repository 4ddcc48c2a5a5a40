"""Row rules."""

import json

from pyspark.sql import functions as F

from wearline.functions import scalar as X
from wearline.functions.validation import missing_columns, parse_requests, split_valid

VALID = {"temperature_C": 85.0, "vibration_mm_s": 3.1, "courant_A": 22.0, "pression_bar": 5.5,
         "vitesse_tr_min": 1350, "age_machine_h": 12000, "h_depuis_maintenance": 400,
         "type_machine": "CNC-Fraisage", "usine_id": "USN-FR-01"}


def test_validation_accepts_and_rejects(spark):
    bad_temp = dict(VALID, temperature_C=500.0)
    bad_type = dict(VALID, type_machine="Inconnu")
    no_site = {k: v for k, v in VALID.items() if k != "usine_id"}
    missing = {k: v for k, v in VALID.items() if k != "courant_A"}
    frac_age = dict(VALID, age_machine_h=12.5)
    bodies = [VALID, bad_temp, bad_type, no_site, missing, frac_age]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "id int, value string")
    ok, bad = split_valid(parse_requests(df))
    assert sorted(r.id for r in ok.collect()) == [0, 3]
    assert ok.where("id = 3").first().usine_id == "USN-FR-01"
    errs = {r.id: r.errors for r in bad.collect()}
    assert errs[1] == ["temperature_C: outside [-20.0, 300.0]"]
    assert errs[2] == ["type_machine: not an accepted value"]
    assert errs[4] == ["courant_A: required"]
    assert errs[5] == ["age_machine_h: not an integer"]
    assert missing_columns(df, ["id", "x", "value", "y"]) == ["x", "y"]


def test_risk_levels(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.29, 0.3, 0.5, 0.79, 0.8, 1.0)], "p double")
    got = [r[0] for r in df.select(X.proba_risk("p")).collect()]
    assert got == ["faible", "faible", "moyen", "élevé", "élevé", "critique", "critique"]
    rul = spark.createDataFrame([(x,) for x in (-3.0, 5.9, 6.0, 11.9, 12.0, 23.9, 24.0)], "r double")
    got = [r[0] for r in rul.select(X.rul_risk(X.rul_floor("r"))).collect()]
    assert got == ["critique", "critique", "élevé", "élevé", "moyen", "moyen", "faible"]


def test_state_label_degradation(spark):
    df = spark.createDataFrame([(1, 10.0, 0), (0, 47.0, 0), (0, 100.0, 0), (0, 500.0, 0), (0, None, 0),
                                (0, 720.0, 4000)], "f int, rul double, h long")
    rows = df.select(X.machine_state("f", "rul"), X.label_within("rul"), X.degradation_score("rul", "h")).collect()
    assert [r[0] for r in rows] == ["en_panne", "critique", "a_risque", "normal", "normal", "normal"]
    assert [r[1] for r in rows] == [1, 0, 0, 0, 0, 0]
    assert rows[5][2] == 0.25


def test_anomaly_levels(spark):
    df = spark.createDataFrame([(True, -0.9), (True, -0.5), (False, -0.9)], "a boolean, s double")
    n = X.anomaly_normalized("s")
    got = [(r[0], r[1]) for r in df.select(F.round(n, 4), X.anomaly_level("a", n)).collect()]
    assert got == [(1.0, "anomalie"), (0.5, "suspect"), (1.0, "normal")]


def test_added_columns(spark):
    from wearline.functions.validation import added_columns
    a = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    b = spark.createDataFrame([(1,)], "y int")
    assert added_columns(a, b) == ["x", "z"]
