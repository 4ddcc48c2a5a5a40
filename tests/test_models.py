"""The models learn: separable classes, a linear target, and what an explanation says."""
import math

from pyspark.sql import functions as F

from wearline.operators import models as ML

FEATS = ["a", "b", "c"]


def _rows(spark, n=800):
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_007)) / 10_007.0
    d = spark.range(n).select("id", unit(1).alias("a"), unit(2).alias("b"), unit(3).alias("c"))
    return d.withColumn("y", (F.col("a") + 0.2 * F.col("b") > 0.7).cast("int")).withColumn("t", 50 * F.col("a") + 20 * F.col("b"))


def test_classifiers_learn_and_explain(spark):
    d = _rows(spark)
    long, models, imps = ML.train_classification(d, FEATS, "y", "id", "t", ML.QUICK, with_cv=False, only=("random_forest", "logistic_regression"))
    auc = {r.model: r.value for r in long.where("metric = 'auc_roc'").collect()}
    assert set(auc) == {"random_forest", "logistic_regression", "svm"} and min(auc.values()) > 0.9
    assert imps["random_forest"][0][0] == "a"
    rows = ML.explain(models["random_forest"], d, FEATS).collect()
    assert len(rows) == 800
    for r in rows:
        assert r.top_features[0].feature == "a" and (r.top_features[0].contribution > 0) == (r.prediction == 1)
        assert r.risk_level and r.recommendation and 0 <= r.probability <= 1


def test_cv_f1_of_a_learnable_label(spark):
    d = _rows(spark, 400)
    long, _, _ = ML.train_classification(d, FEATS, "y", "id", "t", ML.QUICK, with_svm=False, only=("decision_tree",))
    m = {r.metric: r.value for r in long.collect()}
    assert m["cv_f1_mean"] > 0.85 and 0 <= m["cv_f1_std"] < 0.15


def test_regressors_learn_a_linear_target(spark):
    long, models = ML.train_regression(_rows(spark), FEATS, "t", "id", "t", ML.QUICK, only=("random_forest",))
    m = {r.metric.lower(): r.value for r in long.collect()}
    assert next(v for k, v in m.items() if k.startswith("r2")) > 0.9 and all(math.isfinite(v) for v in m.values())
    assert set(models) == {"random_forest"}


def test_registered_queries_fit_the_full_settings(spark, monkeypatch):
    """Every model a query fits has the reference's settings, and no query fits models it does not return."""
    from wearline.plans import q_ml as Q

    asked = []

    class Enough(Exception):
        pass

    def fit(df, features, label, key, tag, params=ML.REFERENCE, *args, only=None, **kwargs):
        asked.append((params, only))
        raise Enough

    monkeypatch.setattr(Q, "prepared", lambda spark, sf: spark.range(1).selectExpr("id", "0 AS failed"))
    monkeypatch.setattr(ML, "train_classification", fit)
    monkeypatch.setattr(ML, "train_regression", fit)
    for query in (Q.q_classifier_metrics, Q.q_cv_f1_scores, Q.q_feature_importance, Q.q_rul_model_metrics, Q.q_batch_scoring):
        try:
            query(spark, "")
        except Enough:
            pass
    trees = ("random_forest", "gradient_boosting")
    assert [o for _, o in asked] == [None, (*trees, "decision_tree"), trees, None, ("random_forest",)]
    assert all(p == ML.REFERENCE for p, _ in asked)


def test_few_rows_are_fitted_in_few_tasks(spark):
    d = spark.range(0, 1000, 1, 16)
    assert ML.fit_parts(d, 1000).rdd.getNumPartitions() == 1 and ML.fit_parts(d, 10**9).rdd.getNumPartitions() == 16


def test_many_rows_are_fitted_in_a_task_per_core(spark):
    """Tasks of a fit grow with the cores, then with MOST_FIT_ROWS; a forest's parts share the cores."""
    cores, d = spark.sparkContext.defaultParallelism, spark.range(0, 1000, 1, 100)
    parts = lambda n, *rows: ML.fit_parts(d, n, *rows).rdd.getNumPartitions()
    assert parts(3 * ML.FIT_ROWS) == 3 and parts(2_000_000) == cores and parts(60 * ML.MOST_FIT_ROWS) == 60
    assert parts(2_000_000, ML.FOREST_ROWS) == 2


def test_forest_of_parts_is_one_forest(spark, tmp_path):
    """Every tree counts once, saved and loaded as well; parts have trees of their own."""
    from pyspark.ml import PipelineModel

    d = _rows(spark)
    p = dict(ML.QUICK, rf_trees=11, rf_depth=4)
    _, models = ML.train_regression(d, FEATS, "t", "id", "t", p, only=("random_forest",))
    forest = models["random_forest"].stages[-1]
    assert forest.getNumTrees == 11 and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 11
    ready = PipelineModel(models["random_forest"].stages[:-1]).transform(d).select("id", "features").limit(20).collect()
    models["random_forest"].write().overwrite().save(str(tmp_path / "m"))
    for model in (models["random_forest"], PipelineModel.load(str(tmp_path / "m"))):
        got = {r["id"]: r["prediction"] for r in model.transform(d).collect()}
        for r in ready:
            assert math.isclose(got[r["id"]], sum(t.predict(r["features"]) for t in forest.trees) / 11, rel_tol=1e-9)
    assert math.isclose(sum(forest.featureImportances), 1.0, rel_tol=1e-9)
