"""Forests and boosted trees grown in tasks: equal to Spark ML's where nothing is drawn, few jobs, no order in the draws."""
import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from wearline.operators import grow as G
from wearline.operators import models as ML
from wearline.operators.scaling import fit_scaler

FEATS = ["a", "b", "c"]


def rows(spark, n=600):
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_007)) / 10_007.0
    d = spark.range(n).select("id", unit(1).alias("a"), unit(2).alias("b"), (unit(3) * 9).cast("int").alias("c"))
    return d.withColumn("y", (F.col("a") + 0.3 * unit(4) > 0.7).cast("int")).withColumn("t", 50 * F.col("a") + 20 * F.col("b") + 5 * unit(5))


def predictions(model, d):
    return np.array([r["prediction"] for r in model.transform(d).select("id", "prediction").orderBy("id").collect()])


def test_boosting_equals_spark_in_few_jobs(spark):
    d = rows(spark).cache()
    stages = ML.feature_stages(FEATS, fit_scaler(d, FEATS))
    for est in (GBTClassifier(labelCol="y", maxIter=12, stepSize=0.1, seed=42), GBTRegressor(labelCol="t", maxIter=12, stepSize=0.1, seed=42)):
        sc, group = spark.sparkContext, f"fit {est.uid}"
        sc.setJobGroup(group, group)
        _, model = ML.fit_pipeline(stages, est, d, 600)
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert jobs < 3 * 12  # Spark ML needs some eight a round
        want = est.fit(PipelineModel(stages).transform(d)).transform(PipelineModel(stages).transform(d))
        want = np.array([r["prediction"] for r in want.select("id", "prediction").orderBy("id").collect()])
        assert np.allclose(predictions(model, d), want, rtol=1e-9, atol=1e-9)


def test_a_forest_depends_on_the_rows_only(spark):
    """However the rows are dealt and ordered, it is the same forest; another seed gives another one."""
    d = rows(spark)
    stages = ML.feature_stages(FEATS, {c: (0.0, 1.0) for c in FEATS})
    for est in (RandomForestClassifier(labelCol="y", numTrees=7, maxDepth=6, minInstancesPerNode=2, seed=42),
                RandomForestRegressor(labelCol="t", numTrees=7, maxDepth=6, featureSubsetStrategy="all", minInstancesPerNode=2, seed=42)):
        got = [predictions(ML.fit_pipeline(stages, e, part, 600)[1], d) for e, part in (
            (est, d.coalesce(1)), (est, d.repartition(7, "b")), (est.copy({est.seed: 43}), d))]
        assert (got[0] == got[1]).all() and (got[0] != got[2]).any()


def test_a_tree_splits_where_most_is_gained():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 8, (2, 300)).astype(np.uint8), rng.normal(size=300)
    w = rng.poisson(1.0, 300).astype(np.uint8)
    t = G.preorder(G.grow(x, y, w, 8, 0, 1, 4, 2, None), 0)
    gains = {}
    for f in range(2):
        for b in range(7):
            left = x[f] <= b
            if min(w[left].sum(), w[~left].sum()) >= 4:
                sse = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()
                gains[f, b] = (sse(np.ones(300, bool)) - sse(left) - sse(~left)) / w.sum()
    best = max(gains, key=gains.get)
    assert (t["feature"][0], t["bin"][0]) == best and np.isclose(t["gain"][0], gains[best])
    left = x[best[0]] <= best[1]
    assert np.allclose(t["stats"][1], [w[left].sum(), (w * y)[left].sum(), (w * y * y)[left].sum()])
    assert t["right"].tolist() == [2, -1, -1]


def test_a_large_table_is_left_to_spark(spark, monkeypatch):
    est = RandomForestClassifier(labelCol="y", numTrees=2, maxDepth=2, seed=1)
    n = G.TABLE_BYTES // (len(FEATS) + 8)
    assert G.fits_here(est, len(FEATS), n) and not G.fits_here(est, len(FEATS), n + 1) and not G.fits_here(est, len(FEATS), 0)
    monkeypatch.setattr(G, "TABLE_BYTES", 100)
    monkeypatch.setattr(G, "grown_trees", None)
    d = rows(spark, 60)
    assert len(predictions(ML.fit_pipeline(ML.feature_stages(FEATS, fit_scaler(d, FEATS)), est, d, 60)[1], d)) == 60


def test_one_class_and_equal_rows(spark):
    """Nothing to split: every tree is a leaf."""
    d = spark.range(50).select("id", *[F.lit(1.0).alias(c) for c in FEATS], F.lit(3.0).alias("t"))
    stages = ML.feature_stages(FEATS, {c: (0.0, 1.0) for c in FEATS})
    for est in (GBTRegressor(labelCol="t", maxIter=3), RandomForestRegressor(labelCol="t", numTrees=3, featureSubsetStrategy="all")):
        assert (predictions(ML.fit_pipeline(stages, est, d, 50)[1], d) == 3.0).all()
