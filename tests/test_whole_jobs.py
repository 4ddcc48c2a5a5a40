"""Registered queries do their whole job on tables that are larger than the smoke tables."""
from pyspark.sql import functions as F

from wearline.plans import q_asof, q_misc


def events(spark, folder, n, users):
    """``n`` events of ``users`` machines, a minute apart, as the driver's table."""
    d = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + 60 * F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % users).alias("user_id"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("value"),
        F.format_string('{"k": %d}', F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100))).alias("props"))
    d.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_recent_readings_are_the_500_latest(spark, tmp_path):
    got = q_asof.q_recent_readings(spark, events(spark, tmp_path, 1300, 2)).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first")).collect()
    assert {(r["user_id"], r["n"], r["first"]) for r in got} == {(0, 500, 300), (1, 500, 301)}


def test_capped_sample_is_of_10000_rows(spark, tmp_path):
    assert q_misc.q_capped_sample(spark, events(spark, tmp_path, 10_050, 3)).distinct().count() == 10_000


def test_forest_scores_do_not_ship_the_models_nodes(spark, tmp_path):
    """What scores is a compact table, equal to Spark's own model and no bigger by the number of tasks."""
    from pyspark.ml.functions import vector_to_array

    from wearline.operators import models as ML
    from wearline.operators.forest import ForestModel
    from wearline.operators.store import ModelStore

    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_007)) / 10_007.0
    d = spark.range(900).select("id", unit(1).alias("a"), unit(2).alias("b"))
    d = d.withColumn("y", (F.col("a") + 0.3 * unit(3) > 0.7).cast("int")).withColumn("t", 50 * F.col("a") + unit(4))
    store, only = ModelStore(spark, str(tmp_path / "models")), ("random_forest",)
    p = dict(ML.QUICK, rf_trees=9, rf_depth=6)
    _, classes, imps = ML.train_classification(d, ["a", "b"], "y", "id", "t", p, store, False, False, only)
    _, values = ML.train_regression(d, ["a", "b"], "t", "id", "t", p, store, only)
    clf, reg = store.load("random_forest_classifier_t"), store.load("random_forest_regressor_t")
    assert isinstance(clf, ForestModel) and isinstance(reg, ForestModel)
    assert dict(zip(["a", "b"], clf.importance)) == dict(imps["random_forest"])
    rows = lambda m, *c: m.transform(d).select("id", *c).orderBy("id").collect()
    proba = vector_to_array("probability").alias("p")
    assert rows(clf, "prediction", proba) == rows(classes["random_forest"], "prediction", proba)
    assert rows(reg, "prediction") == rows(values["random_forest"], "prediction")
    plan = clf.transform(d)._jdf.queryExecution().toString()
    assert "predictRaw" not in plan and "ArrowEvalPython" in plan


def test_isolation_paths_of_a_batch_cost_no_call_per_row(monkeypatch):
    import numpy as np
    import pandas as pd

    from wearline.operators import iforest as IF

    rng = np.random.default_rng(3)
    grown = [IF._grow(t, rng.normal(size=(64, 3)), 6, 7) for t in range(5)]
    nodes = pd.DataFrame([n for t in grown for n in t], columns=["tree", "node", "feature", "threshold", "left", "right", "size", "leaf"])
    x = rng.normal(size=(300, 3))
    x[4, 1] = np.nan  # goes right

    def path(tree, row):
        node, depth = tree[0], 0
        while not node[7]:
            node, depth = tree[node[4] if row[node[2]] < node[3] else node[5]], depth + 1
        return depth + IF.c_factor(float(node[6]))

    want = [sum(path(t, r) for t in grown) / 5 for r in x]
    trees = IF.trees_of(nodes)
    monkeypatch.setattr(IF, "c_factor", None)
    assert np.allclose(IF._path_lengths(trees, x), want, rtol=1e-12, atol=0)
