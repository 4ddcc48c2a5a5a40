"""Supervised models (J3-J10) and the training / scoring jobs.

Every fit is Spark ML on the cluster; the standard scaler (J2, population std)
is a ``SQLTransformer`` stage so a saved ``PipelineModel`` carries it (A9/A10).
Metrics come from :mod:`metrics` (aggregates), splits from :mod:`sampling`.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression,
                                       LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from . import metrics as M
from . import sampling as H
from ..session import current_session, cut_lineage, path_exists, scratch_path
from .forest import ForestModel
from .grow import fit_grown, fits_here
from .knn import KnnModel
from .scaling import fit_scaler

# Model parameters of the reference training job.
REFERENCE = dict(rf_trees=200, rf_depth=15, leaf=2, gbt_iter=200, gbt_depth=5, gbt_rate=0.1, dt_depth=10,
                 lr_iter=1000, svm_cap=10_000, svm_iter=100, knn_k=5, cv_folds=5, seed=42)
# Small settings for quick checks (same model families, fewer trees / rounds).
QUICK = dict(REFERENCE, rf_trees=20, rf_depth=8, gbt_iter=15, gbt_depth=4, dt_depth=8, lr_iter=100, svm_iter=25)
#: Rows of a fitting task, at least and at most. Every task sends the histograms of all open nodes, whatever its rows, so few tasks
#: suffice: no more than the cluster has cores, unless these would hold more than MOST_FIT_ROWS each.
FIT_ROWS = 25_000
MOST_FIT_ROWS = 1_000_000
#: Fits that run at the same time; each one alone leaves most of a cluster idle between its many small jobs.
FITS_AT_ONCE = 8
#: A forest is grown in so many parts at a time, each in few tasks of up to FOREST_ROWS rows: a task sends the histograms of all
#: open nodes of its trees, so dealing out trees costs far less than dealing out rows.
FOREST_PARTS = 8
FOREST_ROWS = 1_000_000
#: Histograms of one pass of a part in MB.
FOREST_MEMORY_MB = 512
#: A forest keeps each row's node instead of walking its trees anew in every pass; cut off after so many passes.
NODE_IDS = dict(cacheNodeIds=True, checkpointInterval=10)
CV_MODELS = ("random_forest", "gradient_boosting", "decision_tree")


def fit_parts(train: DataFrame, n_train: int, rows: int = FIT_ROWS) -> DataFrame:
    """``train`` in one partition per ``rows`` rows, from there on in one per core, or per ``MOST_FIT_ROWS`` rows where that is more;
    a table of fewer partitions keeps them."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.coalesce(max(1, min(-(-n_train // rows), max(cores, -(-n_train // MOST_FIT_ROWS)))))


def side_by_side(spark: SparkSession, work: dict[str, Callable]) -> dict:
    """Results of independent pieces of driver work (fits, evaluations), at most ``FITS_AT_ONCE`` at a time."""
    with ThreadPoolExecutor(max_workers=max(1, min(FITS_AT_ONCE, len(work)))) as pool:
        carry = inheritable_thread_target(spark)  # job tags and properties go along
        running = {k: pool.submit(carry(f)) for k, f in work.items()}
        return {k: r.result() for k, r in running.items()}


def fit_forest(est, train: DataFrame):
    """A random forest grown part by part, side by side, each with a seed of its own; one model of all trees, and the parts."""
    spark, n = train.sparkSession, est.getNumTrees()
    parts = min(FOREST_PARTS, n)
    sizes = [n // parts + (i < n % parts) for i in range(parts)]
    grown = side_by_side(spark, {i: lambda i=i: est.copy({est.numTrees: sizes[i], est.seed: est.getSeed() + 7919 * i}).fit(train) for i in range(parts)})
    kind = "classification" if isinstance(est, RandomForestClassifier) else "regression"
    ml = getattr(spark._jvm.org.apache.spark.ml, kind)
    tree = ml.DecisionTreeClassificationModel if kind == "classification" else ml.DecisionTreeRegressionModel
    trees = spark.sparkContext._gateway.new_array(tree, n)
    for k, t in enumerate(t for i in range(parts) for t in grown[i]._java_obj.trees()):
        trees[k] = t
    first = grown[0]
    if kind == "classification":
        whole = ml.RandomForestClassificationModel(first.uid, trees, first.numFeatures, first.numClasses)
    else:
        whole = ml.RandomForestRegressionModel(first.uid, trees, first.numFeatures)
    count = spark._jvm.org.apache.spark.ml.param.ParamMap()
    count.put(whole.numTrees(), n)  # predictions divide by it
    whole = whole.copy(count)
    model = RandomForestClassificationModel(whole) if kind == "classification" else RandomForestRegressionModel(whole)
    return model, [grown[i] for i in range(parts)]


def fit_pipeline(stages, est, train: DataFrame, n_train: int) -> tuple[PipelineModel, PipelineModel | ForestModel]:
    """``est`` fitted behind the feature stages, which are transformers, and the model that scores: a forest as a compact table."""
    ready = PipelineModel(stages)
    if fits_here(est, len(stages[-1].getInputCols()), n_train):
        return fit_grown(stages, est, ready.transform(train), est.getLabelCol(), n_train, scratch_path(train.sparkSession, f"grown_{uuid.uuid4().hex}"))
    if not isinstance(est, (RandomForestClassifier, RandomForestRegressor)):
        model = PipelineModel([*stages, est.fit(ready.transform(fit_parts(train, n_train)))])
        return model, model
    model, parts = fit_forest(est, ready.transform(fit_parts(train, n_train, FOREST_ROWS)))
    path = scratch_path(train.sparkSession, f"forest_{uuid.uuid4().hex}")
    return PipelineModel([*stages, model]), ForestModel.of(stages, parts, model.featureImportances.toArray(), path)


def scaler_stage(stats: dict, suffix: str = "_s") -> SQLTransformer:
    """J2 as a pipeline stage: (x - mean) / std with the train statistics as literals."""
    exprs = ", ".join(f"(CAST(`{c}` AS DOUBLE) - {m!r}) / {s!r} AS `{c}{suffix}`" for c, (m, s) in stats.items())
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def feature_stages(features, stats: dict):
    return [scaler_stage(stats), VectorAssembler(inputCols=[f"{c}_s" for c in features], outputCol="features",
                                                 handleInvalid="error")]


def classifiers(p: dict, n_train: int) -> dict:
    """J3-J6 estimators (J7 KNN and J8 SVM are separate: no native Spark model)."""
    return {
        "random_forest": RandomForestClassifier(numTrees=p["rf_trees"], maxDepth=p["rf_depth"], minInstancesPerNode=p["leaf"],
                                                maxMemoryInMB=FOREST_MEMORY_MB, seed=p["seed"], **NODE_IDS),
        "gradient_boosting": GBTClassifier(maxIter=p["gbt_iter"], maxDepth=p["gbt_depth"], stepSize=p["gbt_rate"],
                                           seed=p["seed"]),
        "decision_tree": DecisionTreeClassifier(maxDepth=p["dt_depth"], minInstancesPerNode=p["leaf"],
                                                seed=p["seed"]),
        # L2 with C = 1 on the summed loss == regParam 1/n on Spark's mean loss
        "logistic_regression": LogisticRegression(maxIter=p["lr_iter"], regParam=1.0 / max(n_train, 1),
                                                  elasticNetParam=0.0, standardization=False),
    }


def p1(prob_col: str = "probability"):
    return vector_to_array(F.col(prob_col))[1]


def evaluate_classifier(pred: DataFrame, label: str, score: str = "p1") -> dict:
    """D18 + D19 on a prediction frame: one dict of metrics (two one-row aggregates)."""
    m = M.binary_metrics(pred, label, "prediction").first().asDict()
    m["auc_roc"] = M.roc_auc(pred, label, score).first()["auc_roc"]
    return m


def importances(model, features) -> list[tuple[str, float]]:
    """(feature, importance) descending, from a fitted tree model (a short vector)."""
    imp = model.importance if isinstance(model, ForestModel) else model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))


def cv_f1(folds: DataFrame, label: str, stages, est, fold: int) -> float:
    """F1 of one fold of ``folds`` (column ``fold``) by a model fitted on the others."""
    part = folds.where(F.col("fold") != fold)
    _, model = fit_pipeline(stages, est, part, part.count())
    pred = model.transform(folds.where(F.col("fold") == fold))
    return M.binary_metrics(pred, label, "prediction").first()["f1_score"]


def train_classification(df: DataFrame, features, label: str, key, tag: str, params: dict = REFERENCE,
                         store=None, with_cv: bool = True, with_svm: bool = True, only=None, cv_only: bool = False):
    """Stratified split, 50/50 balance of train and test, scaler on train, then every classifier's
    fit with its metrics, and for the tree models one fit per fold (D23), side by side.
    ``only`` names the classifiers wanted (default: all six; ``with_svm`` rules the SVM); ``cv_only`` leaves out the fits on all rows.

    Returns (long metrics DataFrame, {name: model}, {name: importances}); models go to ``store`` as new versions.
    """
    spark = df.sparkSession
    cols = list(features) + [label] + ([key] if isinstance(key, str) else list(key))
    # one short lineage for the many fits that follow (shared checkpoint folder)
    data = cut_lineage(df.select(*dict.fromkeys(cols)).na.drop(subset=list(features)))
    split = cut_lineage(H.stratified_split(data, label, key))
    # each sampling stage hashes with its own seed: re-using one hash order would make
    # a later sample (SVM cap, folds) pick the rows an earlier one favoured
    seed = params["seed"]
    train = cut_lineage(H.balance(split.where(~F.col("is_test")).drop("is_test"), label, key, seed=seed + 1))
    test = cut_lineage(H.balance(split.where(F.col("is_test")).drop("is_test"), label, key, seed=seed + 1))
    n_train = train.count()
    stats = fit_scaler(train, list(features))
    stages = feature_stages(features, stats)
    estimators = {name: est.setLabelCol(label) for name, est in classifiers(params, n_train).items() if only is None or name in only}
    fits: dict[str, Callable] = {name: lambda est=est: fit_pipeline(stages, est, train, n_train) for name, est in estimators.items()}
    if only is None or "knn" in only:
        fits["knn"] = lambda: [KnnModel.fit(train, features, label, stats, params["knn_k"])] * 2
    if with_svm:
        fits["svm"] = lambda: [fit_rff_svm(fit_parts(train, n_train), features, label, stats, params, key)] * 2

    def fitted(fit: Callable):
        model, scorer = fit()
        # read by every metric: scored once
        scored = cut_lineage(scorer.transform(test).select(label, "prediction", p1().alias("p1")))
        return model, scorer, evaluate_classifier(scored, label)

    work: dict = {} if cv_only else {name: lambda fit=fit: fitted(fit) for name, fit in fits.items()}
    cv = [name for name in CV_MODELS if name in estimators] if with_cv else []
    if cv:
        folds = cut_lineage(H.stratified_folds(train, label, key, params["cv_folds"], seed=seed + 3))
        for name in sorted(cv, key=lambda n: n != "gradient_boosting"):  # hundreds of dependent rounds: first of all
            for fold in range(params["cv_folds"]):
                work[name, fold] = lambda est=estimators[name], fold=fold: cv_f1(folds, label, stages, est.copy(), fold)
    done = side_by_side(spark, work)
    rows, models, scorers, imps = [], {}, {}, {}
    for name in {**estimators, **fits}:
        if name in done:
            models[name], scorers[name], m = done[name]
            rows += [(tag, name, k, float(v)) for k, v in m.items() if k in M.CLASSIFICATION_METRICS]
            if name in ("random_forest", "gradient_boosting"):
                imps[name] = importances(scorers[name], features)
        if name in cv:
            scores = [done[name, fold] for fold in range(params["cv_folds"])]
            mean = sum(scores) / len(scores)
            rows += [(tag, name, "cv_f1_mean", mean), (tag, name, "cv_f1_std", math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)))]
    if store is not None:
        for name, model in scorers.items():
            store.publish(f"{name}_classifier_{tag}", model)
    long = spark.createDataFrame(rows, "task string, model string, metric string, value double")
    return long, models, imps


def train_regression(df: DataFrame, features, y: str, key, tag: str, params: dict = REFERENCE, store=None, only=None):
    """Plain 80/20 split, scaler on train, RF and GBT regressors (or ``only`` those named) side by side,
    D22 metrics; models go to ``store`` as new versions."""
    spark = df.sparkSession
    cols = list(features) + [y] + ([key] if isinstance(key, str) else list(key))
    data = cut_lineage(df.select(*dict.fromkeys(cols)).na.drop(subset=list(features) + [y]))
    split = cut_lineage(H.plain_split(data, key, seed=params["seed"]))
    train, test = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    n_train = train.count()
    stages = feature_stages(features, fit_scaler(train, list(features)))
    regs = {
        # the reference's forest regressor considers every feature at each split; it splits no node of fewer
        # than five rows, which two rows a side come nearest to
        "random_forest": RandomForestRegressor(numTrees=params["rf_trees"], maxDepth=params["rf_depth"], featureSubsetStrategy="all",
                                               minInstancesPerNode=params["leaf"], maxMemoryInMB=FOREST_MEMORY_MB, seed=params["seed"], **NODE_IDS),
        "gradient_boosting": GBTRegressor(maxIter=params["gbt_iter"], maxDepth=params["gbt_depth"],
                                          stepSize=params["gbt_rate"], seed=params["seed"]),
    }

    def fitted(est):
        model, scorer = fit_pipeline(stages, est.setLabelCol(y), train, n_train)
        return model, scorer, M.regression_metrics(scorer.transform(test), y, "prediction").first().asDict()

    done = side_by_side(spark, {name: lambda est=est: fitted(est) for name, est in regs.items() if only is None or name in only})
    rows = [(tag, name, k, float(v)) for name, (_, _, m) in done.items() for k, v in m.items()]
    models = {name: model for name, (model, _, _) in done.items()}
    if store is not None:
        for name, (_, scorer, _) in done.items():
            store.publish(f"{name}_regressor_{tag}", scorer)
    return spark.createDataFrame(rows, "task string, model string, metric string, value double"), models


# ---------------------------------------------------------------------------
# RBF-kernel SVM approximated by random Fourier features + LinearSVC
# ---------------------------------------------------------------------------

def rff_params(n_features: int, n_comp: int, gamma: float, seed: int):
    """w ~ N(0, 2 gamma), b ~ U(0, 2 pi): z(x) = sqrt(2/D) cos(W x + b) approximates the
    RBF kernel exp(-gamma |x - y|^2) (Rahimi & Recht 2007)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_comp, n_features))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_comp)
    return w, b


def rff_column(cols, w, b):
    """The feature map as an Arrow-batched pandas UDF: one matrix product per batch."""
    scale = math.sqrt(2.0 / w.shape[0])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rff(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=np.float64) for s in series])
        return pd.Series(list(scale * np.cos(x @ w.T + b)))

    return array_to_vector(rff(*[F.col(c) for c in cols]))


class RffSvmModel:
    """J8 model: scaler -> random Fourier features -> LinearSVC -> logistic fit on the
    margin (probability). ``transform`` adds ``prediction`` and ``probability``."""

    def __init__(self, features, stats, w, b, svm, platt):
        self.features, self.stats, self.w, self.b, self.svm, self.platt = list(features), stats, w, b, svm, platt

    def _margin(self, df: DataFrame) -> DataFrame:
        sc = scaler_stage(self.stats).transform(df)
        z = sc.withColumn("features", rff_column([f"{c}_s" for c in self.features], self.w, self.b))
        out = self.svm.transform(z).withColumn("_margin", vector_to_array("rawPrediction")[1]) \
                  .withColumnRenamed("prediction", "_svm_pred")
        return out.drop("features", "rawPrediction", *[f"{c}_s" for c in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction`` is the sign of the SVM decision; ``probability`` comes from the
        logistic fit on the margin (as an SVC with probability estimates does)."""
        m = self._margin(df)
        m = VectorAssembler(inputCols=["_margin"], outputCol="features").transform(m)
        out = self.platt.transform(m).drop("features", "_margin", "prediction", "rawPrediction")
        return out.withColumnRenamed("_svm_pred", "prediction")

    def save(self, path: str) -> None:
        self.svm.write().overwrite().save(os.path.join(path, "svm"))
        self.platt.write().overwrite().save(os.path.join(path, "platt"))
        meta = {"features": self.features, "stats": self.stats, "w": self.w.tolist(), "b": self.b.tolist()}
        spark = current_session()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
             .write.mode("overwrite").text(os.path.join(path, "meta"))

    @staticmethod
    def load(path: str) -> "RffSvmModel":
        spark = current_session()
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        return RffSvmModel(meta["features"], {k: tuple(v) for k, v in meta["stats"].items()}, np.array(meta["w"]),
                           np.array(meta["b"]), LinearSVCModel.load(os.path.join(path, "svm")),
                           LogisticRegressionModel.load(os.path.join(path, "platt")))


def fit_rff_svm(train: DataFrame, features, label: str, stats: dict, params: dict, key, n_comp: int = 100):
    """At most ``svm_cap`` training rows (hash order); gamma = 1 / (n_features x var)
    of the scaled features (= 1 / n_features); RFF map; LinearSVC; Platt scaling."""
    cap = cut_lineage(H.cap_rows(train, key, params["svm_cap"], seed=params["seed"] + 2))
    w, b = rff_params(len(features), n_comp, 1.0 / len(features), params["seed"])
    shell = RffSvmModel(features, stats, w, b, None, None)
    sc = scaler_stage(stats).transform(cap)
    z = sc.withColumn("features", rff_column([f"{c}_s" for c in features], w, b))
    # C = 1 on the summed loss of the rows fitted; the mapped features are not scaled again
    shell.svm = LinearSVC(labelCol=label, maxIter=params["svm_iter"], regParam=1.0 / max(cap.count(), 1), standardization=False).fit(z)
    marg = VectorAssembler(inputCols=["_margin"], outputCol="features").transform(shell._margin(cap).drop("_svm_pred"))
    shell.platt = LogisticRegression(labelCol=label, maxIter=100).fit(marg)
    return shell


# ---------------------------------------------------------------------------
# Scoring (J16-J18, J20, J21)
# ---------------------------------------------------------------------------

def load_model(path: str) -> PipelineModel:
    """A10: load a saved pipeline by its folder (the store's models by name); a missing one is a clear error."""
    if not path_exists(current_session(), path):
        raise FileNotFoundError(f"model not found: {path}")
    return PipelineModel.load(path)


def score_classifier(model, df: DataFrame, proba_digits: int = 4) -> DataFrame:
    """Prediction, probability of class 1 (rounded), risk level and advice."""
    from ..functions.scalar import proba_advice, proba_risk
    out = model.transform(df).withColumn("p1", p1())
    return out.select(*df.columns, F.col("prediction").cast("int").alias("prediction"),
                      F.round("p1", proba_digits).alias("probability"),
                      proba_risk("p1").alias("risk_level"), proba_advice("p1").alias("recommendation"))


def score_rul(model, df: DataFrame, digits: int = 2) -> DataFrame:
    """RUL floored at 0 (I5), risk level and advice (I3), rounded."""
    from ..functions.scalar import rul_advice, rul_floor, rul_risk
    out = model.transform(df).withColumn("_rul", rul_floor("prediction"))
    return out.select(*df.columns, F.round("_rul", digits).alias("estimated_rul_hours"),
                      rul_risk("_rul").alias("risk_level"), rul_advice("_rul").alias("recommendation"))


def top_contributions(importances_of: dict[str, float], top: int = 3) -> "F.Column":
    """the ``top`` features by |contribution| (importance, signed by ``prediction``), ties in the features' order, with raw
    values (rounded 3), contributions (rounded 4) and direction (I7)."""
    from ..functions.scalar import direction
    sign = F.when(F.col("prediction") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col(f).cast("double"), 3).alias("value"),
                               (F.lit(float(i)) * sign).alias("c")) for f, i in importances_of.items()])
    ranked = F.slice(F.array_sort(items, lambda a, b: F.when(F.abs(a["c"]) > F.abs(b["c"]), -1)
                                  .when(F.abs(a["c"]) < F.abs(b["c"]), 1).otherwise(0)), 1, top)
    return F.transform(ranked, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"),
                                                  F.round(x["c"], 4).alias("contribution"), direction(x["c"]).alias("direction")))


def explain(model, df: DataFrame, features, top: int = 3) -> DataFrame:
    """Global importances signed by the prediction (F4); risk level and advice from the probability itself."""
    from ..functions.scalar import proba_advice, proba_risk
    imp = dict(zip(features, model.importance if isinstance(model, ForestModel) else model.stages[-1].featureImportances.toArray().tolist()))
    scored = model.transform(df).withColumn("p1", p1())
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"),
                         F.round("p1", 4).alias("probability"), proba_risk("p1").alias("risk_level"),
                         proba_advice("p1").alias("recommendation"), top_contributions(imp, top).alias("top_features"))
