"""Chunked (skew-safe) per-machine operators equal the plain per-machine windows."""

import datetime as dt

from pyspark.sql import functions as F

from wearline.operators.series import every_nth, last_n, lifecycle, rolling_features, row_index
from wearline.sources.events import event_readings
from wearline.spec import EVENTS_SPEC, RAW_SPEC

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_rolling_chunked_equals_plain(spark):
    r = event_readings(spark, SF_SMALL)
    cols = ["event_id", "value_mean_24h", "value_std_24h", "k_mean_24h", "k_std_24h"]
    plain = _rows(rolling_features(r, EVENTS_SPEC, split=False), cols)
    for secs in (3600, 86_400, 7 * 86_400):
        got = _rows(rolling_features(r, EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=secs)), cols)
        assert got == plain, secs


def test_rolling_hand_computed(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("M1", base + dt.timedelta(hours=i), float(v)) for i, v in enumerate([1, 3, 5, 7])]
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, temperature_C double")
    out = rolling_features(df, RAW_SPEC.with_(chunk_rows=None, chunk_seconds=7200), window=3, cols=["temperature_C"])
    got = sorted((r[0], r[1], r[2]) for r in out.select("timestamp", "temperature_mean_3h", "temperature_std_3h")
                 .collect())
    assert [g[1] for g in got] == [1.0, 2.0, 3.0, 5.0]
    assert got[0][2] == 0.0  # one-row window: std 0
    assert abs(got[3][2] - 2.0) < 1e-12  # std of 3, 5, 7


def test_lifecycle_chunked_equals_unchunked(spark):
    r = event_readings(spark, SF_SMALL)
    cols = ["event_id", "fail_start", "n_failures", "maint_edge", "n_maint", "since_maint_h", "age_h", "rul",
            "state", "fail_24h"]
    big = _rows(lifecycle(r, EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=10 ** 9)), cols)
    for secs in (3600, 86_400):
        assert _rows(lifecycle(r, EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=secs)), cols) == big


def test_maintenance_counter_hand_computed(spark):
    base = dt.datetime(2024, 1, 1)
    flags = [0, 0, 1, 1, 0, 0, 1, 0]
    rows = [("M1", base + dt.timedelta(hours=i), f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, en_panne int")
    out = lifecycle(df, RAW_SPEC.with_(chunk_rows=None, chunk_seconds=3 * 3600), initial_since_maint=10).orderBy("timestamp")
    got = out.select("fail_start", "n_failures", "maint_edge", "n_maint", "since_maint_h", "rul_heures").collect()
    assert [g[0] for g in got] == [0, 0, 1, 0, 0, 0, 1, 0]
    assert [g[1] for g in got] == [0, 0, 1, 1, 1, 1, 2, 2]
    assert [g[2] for g in got] == [0, 0, 0, 0, 1, 0, 0, 1]
    assert [g[4] for g in got] == [11, 12, 13, 14, 1, 2, 3, 1]  # reset row reads 1
    assert [g[5] for g in got] == [2.0, 1.0, 4.0, 3.0, 2.0, 1.0, 720.0, 720.0]


def test_row_index_last_n_every_nth(spark):
    r = event_readings(spark, SF_SMALL).select("event_id", "user_id", "ts")
    spec = EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=3600)
    idx = row_index(r, spec)
    per = idx.groupBy("user_id").agg(F.count("*").alias("n"), F.max("row_idx").alias("mx"), F.min("row_idx").alias("mn"))
    assert per.where((F.col("mx") != F.col("n") - 1) | (F.col("mn") != 0)).count() == 0
    ln = last_n(r, spec, 3)
    assert ln.groupBy("user_id").count().where("count > 3").count() == 0
    assert every_nth(r, spec, 4).count() == idx.where(F.col("row_idx") % 4 == 0).count()


HOT = dict(chunk_rows=10, min_chunk_seconds=600)


def test_adaptive_chunks_equal_plain(spark):
    """Hot machines (here: all, > 10 rows) get narrower chunks; results must not change."""
    from wearline.operators.series import attach_chunk_widths, with_chunk
    r = event_readings(spark, SF_SMALL)
    spec = EVENTS_SPEC.with_(**HOT)
    n_chunks = with_chunk(r, spec).select("user_id", "_chunk").distinct().count()
    assert n_chunks > with_chunk(r, EVENTS_SPEC).select("user_id", "_chunk").distinct().count()
    cols = ["event_id", "value_mean_24h", "value_std_24h", "k_mean_24h", "k_std_24h"]
    plain = _rows(rolling_features(r, EVENTS_SPEC, split=False), cols)
    assert _rows(rolling_features(r, spec), cols) == plain
    lc = ["event_id", "n_failures", "n_maint", "since_maint_h", "age_h", "rul"]
    want = _rows(lifecycle(r, EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=10 ** 9)), lc)
    assert _rows(lifecycle(attach_chunk_widths(r, spec), spec), lc) == want
    assert _rows(lifecycle(r, spec), lc) == want


def test_asof_operators_chunk_invariant(spark):
    from wearline.operators.asof import counts_in_past, failure_horizon, inside_intervals, last_event_before
    r = event_readings(spark, SF_SMALL)
    rd = r.select("event_id", "user_id", "ts")
    errs = r.where("event_type = 'error'").select(
        "user_id", "ts", F.concat(F.lit("e"), (F.col("k").cast("int") % 3).cast("string")).alias("etype"))
    maint = r.where("event_type = 'signup'").select("user_id", "ts", "event_id", F.lit("c1").alias("comp"))
    fl = r.where("event_type = 'purchase'").select("user_id", "ts")
    iv = r.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"),
                                                   F.expr("ts + INTERVAL 3 HOURS").alias("end"))
    outs = []
    for spec in (EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=10 ** 9), EVENTS_SPEC.with_(**HOT),
                 EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=86_400)):
        outs.append((
            _rows(counts_in_past(rd, errs, spec, ["e0", "e1", "e2"], "etype", 24), ["event_id", "e0_24h", "e1_24h",
                                                                                   "e2_24h"]),
            _rows(last_event_before(rd, maint, spec, ["c1"], "comp"), ["event_id", "since_c1_h"]),
            _rows(failure_horizon(rd, fl, spec), ["event_id", "hours_to_failure", "failure_within_24h"]),
            _rows(inside_intervals(rd, iv, spec), ["event_id", "in_interval"]),
        ))
    assert outs[0] == outs[1] == outs[2]


def test_interval_edges(spark):
    """Start inclusive, end exclusive."""
    from wearline.operators.asof import inside_intervals
    t0 = dt.datetime(2024, 1, 1)
    rd = spark.createDataFrame([(1, "M", t0), (2, "M", t0 + dt.timedelta(hours=1)),
                                (3, "M", t0 + dt.timedelta(hours=2)), (4, "N", t0)],
                               "id int, machine_id string, timestamp timestamp_ntz")
    iv = spark.createDataFrame([("M", t0, t0 + dt.timedelta(hours=2))],
                               "machine_id string, start timestamp_ntz, end timestamp_ntz")
    got = {r.id: r.in_interval for r in inside_intervals(rd, iv, RAW_SPEC.with_(tie="id")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_rolling_matches_pandas_definition(spark):
    """E1/E2 against pandas rolling(24, min_periods=1) per machine, with missing values
    and several chunks per machine."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(7)
    rows = []
    for m in ("A", "B", "C"):
        n = int(rng.integers(30, 90))
        for i in range(n):
            v = None if rng.random() < 0.1 else float(rng.normal(80, 10))
            rows.append((m, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), v))
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, temperature_C double")
    spec = RAW_SPEC.with_(chunk_rows=None, chunk_seconds=6 * 3600, sensors=("temperature_C",))
    got = rolling_features(df, spec).toPandas().sort_values(["machine_id", "timestamp"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["machine_id", "timestamp", "temperature_C"]).sort_values(
        ["machine_id", "timestamp"]).reset_index(drop=True)
    g = pdf.groupby("machine_id")["temperature_C"]
    mean = g.transform(lambda x: x.rolling(24, min_periods=1).mean())
    std = g.transform(lambda x: x.rolling(24, min_periods=1).std().fillna(0))
    assert np.allclose(got["temperature_mean_24h"].astype(float), mean, equal_nan=True)
    assert np.allclose(got["temperature_std_24h"].astype(float), std, equal_nan=True)
