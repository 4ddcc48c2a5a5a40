"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query's plan runs to completion into the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wearline.plans import catalog  # noqa: E402
from wearline.session import get_spark  # noqa: E402

HEADLINE = [
    "prepared_readings", "rolling_features", "machine_lifecycle", "fleet_kpis", "site_state_counts",
    "top_failure_machines", "daily_failures", "corr_matrix", "sensor_describe", "box_stats_by_state",
    "sensor_histogram", "roc_auc", "class_report", "readings_in_failure", "hours_since_maintenance",
    "error_counts_24h", "failure_horizon", "stratified_split", "balanced_sample", "scaled_features",
    "knn_predictions", "classifier_metrics", "rul_model_metrics", "anomaly_scores", "stream_daily_failures",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    catalog.load_all()
    times = {}
    for name in only:
        t0 = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
        spark.catalog.clearCache()  # each query starts without the previous one's cached frames
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))


if __name__ == "__main__":
    main()
