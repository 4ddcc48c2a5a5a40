"""Broken lines are set aside, days are final once, requests are scored by published models, bursts are cut."""
import datetime as dt

from pyspark.sql import functions as F

from wearline.operators.encode import category_maps, numbered
from wearline.operators.reports import corr_matrix, correlations
from wearline.operators.series import chunk_levels, lifecycle, rolling_features, with_chunk
from wearline.plans import jobs
from wearline.sources import io
from wearline.sources.events import event_readings
from wearline.spec import EVENTS_SPEC, RAW_SPEC
from wearline.streaming.scoring import serving_scorer, start_daily_failures, start_scoring
from conftest import SF_SMALL

SINGLE = ("UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],Tool wear [min],"
          "Machine failure,TWF,HDF,PWF,OSF,RNF\n")


def test_broken_lines_are_set_aside(spark, tmp_path):
    src = tmp_path / "single.csv"
    src.write_text(SINGLE + "1,M14860,M,298.1,308.6,1551,42.8,0,0,0,0,0,0,0\n2,L47181,L,hot,308.7,1408,46.3,3,0,0,0,0,0,0\n"
                   "3,L47182,L,298.1,308.5,1498\n4,L47183,L,298.2,308.6,1433,39.5,7,1,1,0,0,0,0\n")
    rows = io.read_event_table(spark, str(src), "single", str(tmp_path / "bad"))
    assert [r["UDI"] for r in rows.select("UDI").orderBy("UDI").collect()] == [1, 4]  # however few columns are read
    assert rows.agg(F.sum("Machine failure"), F.sum("TWF")).first()[:] == (1, 1)
    bad = io.read_quarantine(spark, str(tmp_path / "bad")).collect()
    assert sorted(r["line"].split(",")[0] for r in bad) == ["2", "3"] and all(r["file"].endswith("single.csv") for r in bad)
    assert io.read_event_table(spark, str(src), "single").count() == 4  # permissive without a quarantine
    batch = io.read_batch_csv(spark, str(src), "UDI int, `Product ID` string", str(tmp_path / "bad2"))
    assert batch.count() == 0  # surplus fields do not fit either


def daily(spark, folder, base, watermark):
    src = spark.readStream.schema("ts timestamp_ntz, failed int").option("maxFilesPerTrigger", 1).parquet(folder)
    start_daily_failures(src, f"{base}/out", f"{base}/ckpt", watermark=watermark).awaitTermination()
    return {str(r["day"]): r["failure_rows"] for r in spark.read.parquet(f"{base}/out").collect()}


def test_daily_stream_drops_rows_behind_the_watermark(spark, tmp_path):
    at = lambda d, h=12: dt.datetime(2024, 1, d, h)
    deliveries = [[(at(1), 1), (at(1, 13), 1), (at(2), 1)], [(at(5), 1), (at(1), 1)], [(at(6), 1), (at(5), 1)],
                  [(at(7), 1), (at(1), 1), (at(6), 1)], [(at(31), 0)]]
    folder = str(tmp_path / "in")
    for rows in deliveries:
        spark.createDataFrame(rows, "ts timestamp_ntz, failed int").coalesce(1).write.mode("append").parquet(folder)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # days stay UTC days
        got = daily(spark, folder, str(tmp_path), "1 day")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    # the row of day 1 in the second delivery is in time (nothing has passed yet), the one in the fourth is not
    assert got == {"2024-01-01": 3, "2024-01-02": 1, "2024-01-05": 2, "2024-01-06": 2, "2024-01-07": 1}
    assert daily(spark, folder, str(tmp_path), "1 day") == got  # started again: nothing is written twice


def test_requests_are_scored_like_the_batch_job(spark, tmp_path):
    from wearline.operators import models as ML
    from wearline.plans import q_misc, q_stream

    params = dict(ML.QUICK, rf_trees=5, rf_depth=4)
    base = str(tmp_path / "serving")
    store, maps = q_stream.serving_models(spark, SF_SMALL, base, params)
    reqs = q_misc._requests(spark, SF_SMALL)
    reqs.select(F.col("body").alias("value")).write.text(f"{base}/in")
    score = serving_scorer(spark, store.base, jobs.TAG, jobs.TAG_24H)
    start_scoring(spark, f"{base}/in", f"{base}/out", f"{base}/bad", f"{base}/ckpt", score, maps).awaitTermination()
    out, bad = spark.read.parquet(f"{base}/out"), spark.read.parquet(f"{base}/bad")
    assert out.count() + bad.count() == reqs.count() and out.count() > 0 and bad.where(F.size("errors") == 0).count() == 0
    want = jobs.score_table(spark, out.select("value", *RAW_SPEC.features), store.base)
    want = {r["value"]: (r["panne_dans_24h"], r["probabilite"], r["risque"], r["rul_estime_h"]) for r in want.collect()}
    for r in out.collect():
        label, p, risk, rul = want[r["value"]]
        assert (label, p, risk) == (r["prediction_24h"], r["probability_24h"], r["risk_level_24h"].upper())
        assert abs(rul - r["estimated_rul_hours"]) <= 0.051 and r["prediction"] in (0, 1) and r["rul_risk_level"]
    unknown = out.where("usine_id = 'USN-FR-01'").limit(1).drop("usine_encoded", "type_machine_encoded").withColumn("usine_id", F.lit("elsewhere"))
    from wearline.operators.encode import encode
    from wearline.spec import ENCODED
    assert encode(unknown, maps, ENCODED).first()["usine_encoded"] == 0


def test_a_burst_is_cut_and_changes_nothing(spark):
    """Half of a machine's rows lie in one second, far below ``min_chunk_seconds``."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, k, t0 + dt.timedelta(hours=k), float(k % 17), float(k % 5), int(k % 11 == 0)) for k in range(150)]
    rows += [(1, 1000 + k, t0 + dt.timedelta(days=2, microseconds=37 * k), float(k % 13), 1.0, int(k % 9 == 0)) for k in range(150)]
    rows += [(1, 2000, None, 3.0, 1.0, 0), (2, 3000, t0, 1.0, 1.0, 1)]
    d = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, value double, k double, failed int") \
        .withColumns({"site": F.lit("a"), "mtype": F.lit("b")})
    spec, plain = EVENTS_SPEC.with_(chunk_rows=20, min_chunk_seconds=3600), EVENTS_SPEC.with_(chunk_rows=None, chunk_seconds=10**9)
    assert len(chunk_levels(d, spec)) > 1
    sizes = [r["count"] for r in with_chunk(d, spec).groupBy("user_id", "_chunk").count().collect()]
    assert max(sizes) <= 60 and len(sizes) >= 8
    for f, cols in ((rolling_features, ["value_mean_24h", "value_std_24h"]), (lifecycle, ["n_failures", "since_maint_h", "rul", "row_idx"])):
        pick = lambda df, cols=cols: {r["event_id"]: tuple(None if r[c] is None else round(float(r[c]), 9) for c in cols) for r in df.collect()}
        assert pick(f(d, spec)) == pick(f(d, plain))


def test_codes_over_many_partitions(spark):
    n = 5000
    d = spark.range(n).select(F.format_string("c%06d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    got = {(r["feature"], r["category"]): r["code"] for r in category_maps(d, ["a", "b"]).collect()}
    assert got == {**{("a", f"c{k:06d}"): k for k in range(n)}, **{("b", str(k)): k for k in range(3)}}
    values = d.select(F.lit("a").alias("feature"), F.col("a").alias("category"))
    assert numbered(values, "feature", "category", "n").agg(F.countDistinct("n")).first()[0] == n


def test_distinct_pairs_give_the_whole_matrix(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 1.0, 5.0), (4.0, 7.0, 5.0)], "x double, y double, z double")
    whole = {(r["a"], r["b"]): r["r"] for r in corr_matrix(d, ["x", "y", "z"]).collect()}
    pairs = {(r["a"], r["b"]): r["r"] for r in correlations(d, [(a, b) for a in "xyz" for b in "xyz"]).collect()}
    assert len(whole) == 9
    for k, v in pairs.items():
        assert (whole[k] is None) == (v is None) and (v is None or repr(round(whole[k], 9)) == repr(round(v, 9)))


def test_entry_point_without_a_dependency(monkeypatch):
    import sys

    import __spark_entry__ as E

    for name in [m for m in sys.modules if m.startswith("wearline.llm")] + ["regex", "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "regex", None)
    names = E.queries()
    assert len(names) >= 62 and not any(n.startswith("op") for n in names) and not any(n.startswith("op") for n in E.oracle_sql())


def test_first_event_readings_have_no_hot_machine(spark):
    r = event_readings(spark, SF_SMALL)
    assert chunk_levels(r, EVENTS_SPEC) == []
