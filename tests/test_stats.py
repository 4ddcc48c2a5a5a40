"""Quantiles, AUC, sampling and KNN against brute force on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from wearline.operators import metrics as M
from wearline.operators import sampling as H
from wearline.operators.knn import knn_classify
from wearline.operators.quantiles import percentiles
from wearline.session import table
from wearline.sources.events import event_readings

from conftest import SF_SMALL


def test_percentiles_match_numpy(spark):
    r = event_readings(spark, SF_SMALL)
    got = percentiles(r, "value", (0.05, 0.25, 0.5, 0.75, 0.95), ["failed"]).collect()
    pdf = r.select("failed", "value").toPandas()
    for row in got:
        v = pdf[pdf.failed == row.failed].value.to_numpy()
        for p in (5, 25, 50, 75, 95):
            assert abs(row[f"p{p}"] - np.percentile(v, p)) < 1e-9


def test_percentiles_refine_many_rounds(spark, monkeypatch):
    import wearline.operators.quantiles as Q
    monkeypatch.setattr(Q, "FINISH_ROWS", 5)
    monkeypatch.setattr(Q, "BUCKETS", 4)
    df = spark.range(0, 997).select((F.col("id") * 7 % 101).cast("double").alias("x"))
    got = Q.percentiles(df, "x", (0.1, 0.5, 0.9)).first()
    v = np.array([i * 7 % 101 for i in range(997)], dtype=float)
    assert [got.p10, got.p50, got.p90] == [np.percentile(v, 10), np.percentile(v, 50), np.percentile(v, 90)]


def test_auc_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 1)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = M.roc_auc(df, "y", "s", chunks=4).first()[0]
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12
    one = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, s double")
    assert M.roc_auc(one, "y", "s").first()[0] == 0.0


def test_balance_and_folds(spark):
    r = event_readings(spark, SF_SMALL).select("event_id", "failed")
    bal = H.balance(r, "failed", "event_id")
    counts = {x.failed: x["count"] for x in bal.groupBy("failed").count().collect()}
    assert counts[0] == counts[1] == r.where("failed = 1").count()
    folds = H.stratified_folds(bal, "failed", "event_id", 5)
    sizes = folds.groupBy("fold").count().collect()
    assert sorted(x.fold for x in sizes) == [0, 1, 2, 3, 4]
    assert folds.count() == bal.count() == folds.select("event_id").distinct().count()
    sp = H.stratified_split(r, "failed", "event_id")
    for cls in (0, 1):
        n = r.where(f"failed = {cls}").count()
        assert sp.where(f"failed = {cls} AND is_test").count() == round(0.2 * n)


def test_knn_brute_force(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    sp = H.plain_split(emb, "vec_id")
    tr, te = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    got = {r.vec_id: r.pred for r in knn_classify(tr, te, "vec_id", "embedding", "label", 5).collect()}
    trp, tep = tr.toPandas(), te.toPandas()
    X = np.stack(trp.embedding.map(lambda v: np.asarray(v, dtype=float)))
    for _, q in tep.iterrows():
        d = np.sqrt(((X - np.asarray(q.embedding, dtype=float)) ** 2).sum(axis=1))
        order = np.lexsort((trp.vec_id.to_numpy(), d))[:5]
        votes = {}
        for i in order:
            votes[trp.label[i]] = votes.get(trp.label[i], 0.0) + 1.0 / d[i]
        best = sorted(votes.items(), key=lambda t: (-t[1], t[0]))[0][0]
        assert got[q.vec_id] == best


def test_daily_sum_fills_empty_days(spark):
    """Days without rows appear with 0."""
    import datetime as dt
    from wearline.operators.reports import daily_sum
    rows = [(dt.datetime(2024, 1, 1, 5), 1), (dt.datetime(2024, 1, 1, 9), 1), (dt.datetime(2024, 1, 4, 2), 0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, failed int")
    got = [(r.day.day, r.n) for r in daily_sum(df, "ts", "failed", "n").orderBy("day").collect()]
    assert got == [(1, 2), (2, 0), (3, 0), (4, 0)]
