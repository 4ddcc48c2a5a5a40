"""Driver contract and a few model properties."""

import __spark_entry__ as E
from pyspark.sql import functions as F

from wearline.operators import iforest as IF
from wearline.operators import models as ML
from wearline.plans.q_misc import prepared
from wearline.spec import EVENTS_SPEC

from conftest import SF_SMALL


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "value_mean_24h" in df.columns and "rul" in df.columns


def test_models_train_save_load(spark, tmp_path):
    p = prepared(spark, SF_SMALL)
    feats = list(EVENTS_SPEC.features)
    long, models, imps = ML.train_classification(p, feats, "failed", "event_id", "t", ML.QUICK,
                                                 with_cv=False, with_svm=True)
    m = {(r.model, r.metric): r.value for r in long.collect()}
    assert all(0.0 <= v <= 1.0 for v in m.values())
    assert abs(sum(v for _, v in imps["random_forest"]) - 1.0) < 1e-6
    path = str(tmp_path / "rf")
    models["random_forest"].write().overwrite().save(path)
    back = ML.load_model(path)
    a = ML.score_classifier(models["random_forest"], p.select("event_id", *feats)).orderBy("event_id").collect()
    b = ML.score_classifier(back, p.select("event_id", *feats)).orderBy("event_id").collect()
    assert a == b
    assert all(0.0 <= r.probability <= 1.0 for r in a)


def test_isolation_forest_rates(spark):
    p = prepared(spark, SF_SMALL)
    feats = list(EVENTS_SPEC.features)
    out, cut = IF.fit_and_flag(p, p, feats, "event_id", trees=20)
    rate = out.agg(F.avg("anomaly")).first()[0]
    assert 0.0 < rate < 0.15
    assert out.where((F.col("iso_score") >= 0) | (F.col("iso_score") < -1)).count() == 0


def test_svm_save_load_and_report(spark, tmp_path):
    from wearline.operators import sampling as H
    from wearline.operators.metrics import class_report
    from wearline.operators.scaling import fit_scaler
    p = prepared(spark, SF_SMALL)
    feats = list(EVENTS_SPEC.features)
    train = H.balance(p.select("event_id", *feats, "failed"), "failed", "event_id")
    svm = ML.fit_rff_svm(train, feats, "failed", fit_scaler(train, feats), ML.QUICK, "event_id")
    path = str(tmp_path / "svm")
    svm.save(path)
    back = ML.RffSvmModel.load(path)
    a = svm.transform(train).select("event_id", "prediction", ML.p1().alias("p")).orderBy("event_id").collect()
    b = back.transform(train).select("event_id", "prediction", ML.p1().alias("p")).orderBy("event_id").collect()
    assert a == b
    rep = {r["class"]: r for r in class_report(svm.transform(train), "failed", "prediction").collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
