"""Guards for plans that have to stay linear, and for ties, missing values and replays."""
import time

from pyspark.sql import functions as F

from wearline.operators.asof import counts_in_past
from wearline.operators.quantiles import percentiles
from wearline.operators.series import lifecycle, rolling_features, with_chunk
from wearline.sources import io
from wearline.functions.validation import parse_requests, split_valid
from wearline.spec import EVENTS_SPEC, RAW_SCHEMA
from wearline.streaming.scoring import start_scoring


def _dense(spark, n):
    """One machine, one row a second, failed in one row of a hundred."""
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    return (spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"),
                                  F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"),
                                  (F.col("id") % 100 == 99).cast("int").alias("failed"))
            .where(start.isNotNull()))


def _timed(df):
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def test_lifecycle_is_linear_in_a_chunk(spark):
    run = lambda n: _timed(lifecycle(_dense(spark, n), EVENTS_SPEC))
    run(1_000)
    small, large = run(40_000), run(160_000)
    assert large < 8 * small + 2  # a quadratic frame takes 16 times as long, minutes here


def test_counts_in_past_is_linear_and_right(spark):
    d = _dense(spark, 60_000)
    ev = d.where("failed = 1").select("user_id", "ts", "event_id", F.lit("e").alias("kind"))
    t = time.perf_counter()
    out = counts_in_past(d, ev, EVENTS_SPEC, ["e"], "kind", hours=2)
    got = {r["event_id"]: r["e_24h"] for r in out.where("event_id % 9973 = 0 or event_id in (99, 7299, 7300)").collect()}
    assert time.perf_counter() - t < 60
    for i, n in got.items():  # failures at 99, 199, ... within [i - 7200, i]
        assert n == sum(1 for k in range(99, i + 1, 100) if k >= i - 7200)


def test_percentile_of_ties_needs_no_window_over_them(spark):
    d = spark.range(400_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(7.0)).alias("x"))
    r = percentiles(d, "x", (0.25, 0.5, 0.75)).first()
    assert (r["p25"], r["p50"], r["p75"]) == (7.0, 7.0, 7.0)


def test_repeated_timestamps_keep_every_row_once(spark):
    d = spark.range(300).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"),
                                F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("ts"), F.col("id").cast("double").alias("value"),
                                F.col("id").cast("int").alias("k"), F.lit(0).alias("failed"))
    out = rolling_features(d, EVENTS_SPEC, 24)
    assert sorted(r["event_id"] for r in out.select("event_id").collect()) == list(range(300))


def test_nan_field_is_missing(spark, tmp_path):
    names = [f.name for f in RAW_SCHEMA.fields]
    row = {f.name: {"string": "x", "timestamp_ntz": "2024-01-01 00:00:00"}.get(f.dataType.typeName(), "1") for f in RAW_SCHEMA.fields}
    row["temperature_C"] = "NaN"
    (tmp_path / io.RAW_FILE).write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    assert io.read_raw(spark, str(tmp_path)).first()["temperature_C"] is None


def test_whole_valued_float_is_an_integer(spark):
    body = ('{"temperature_C": 50, "vibration_mm_s": 2, "courant_A": 10, "pression_bar": 5, "vitesse_tr_min": 1000, '
            '"age_machine_h": %s, "h_depuis_maintenance": 5}')
    raw = spark.createDataFrame([(body % "12000.0",), (body % "12000.5",)], "value string")
    ok, bad = split_valid(parse_requests(raw, "value"))
    assert [r["age_machine_h"] for r in ok.collect()] == [12000] and bad.count() == 1


def test_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    body = ('{"temperature_C": 50, "vibration_mm_s": 2, "courant_A": 10, "pression_bar": 5, "vitesse_tr_min": 1000, '
            '"age_machine_h": 1, "h_depuis_maintenance": 5}')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(body + "\n" + body + "\n")
    for k in range(2):  # a lost checkpoint makes the stream start with batch 0 again
        q = start_scoring(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / f"ckpt{k}"), lambda d: d)
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_rolling_cuts_hot_machines_only(spark):
    """Machine 1 has 400 rows (hot), the others 20: only machine 1 is cut, all equal the plain window."""
    spec = EVENTS_SPEC.with_(chunk_rows=100, min_chunk_seconds=1)
    d = (spark.range(500).select(F.when(F.col("id") < 400, F.lit(1)).otherwise(2 + F.floor((F.col("id") - 400) / 20)).cast("long").alias("user_id"),
                                 F.col("id").alias("event_id"), F.expr("timestampadd(SECOND, id % 400 * 600, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"),
                                 (F.col("id") * 7919 % 101).cast("double").alias("value"), (F.col("id") % 13).cast("int").alias("k"),
                                 F.lit(0).alias("failed")))
    chunks = {r["user_id"]: r["n"] for r in with_chunk(d, spec).groupBy("user_id").agg(F.countDistinct("_chunk").alias("n")).collect()}
    assert chunks[1] >= 3 and {n for m, n in chunks.items() if m != 1} == {1}
    cols = ["event_id"] + [F.round(c, 9) for c in ("value_mean_24h", "value_std_24h", "k_mean_24h", "k_std_24h")]
    got = rolling_features(d, spec, 24).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rolling_features(d, spec, 24, split=False).select(*cols).collect()))
