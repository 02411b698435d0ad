"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully executed with the ``noop`` sink (no driver collection) and timed
wall-clock after one warm-up query that starts the JVM.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fraud_by_type", "build_features", "describe", "fraud_by_amount_decile", "correlation_matrix",
    "frauds_per_client", "mule_overlap", "stratified_split", "apply_scaler", "smote",
    "score_curve", "fraud_metrics", "optimal_threshold", "threshold_sweep", "test_at_val_threshold",
    "top_suspect_features", "logistic_balanced", "pca_detector", "describe_lineitem",
]


#: not in the total: the heaviest fits, and SMOTE at a tenth of the scale, whose slope shows a quadratic plan
EXTRA = ["forest_balanced", "logistic_cv"]


def timed(fn, spark, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t0, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from riskloom.plans.registry import load_all
    from riskloom.session import build_session

    spark = build_session(app_name="riskloom-bench")
    reg = load_all()
    reg["transactions"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    times = {name: timed(reg[name][0], spark, sf_dir) for name in HEADLINE}
    extra = {name: timed(reg[name][0], spark, sf_dir) for name in EXTRA}
    smaller = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    if os.path.isdir(smaller) and os.path.basename(sf_dir.rstrip("/")) == "sf0.1":
        extra["smote_sf0.01"] = timed(reg["smote"][0], spark, smaller)
        extra["smote_slope"] = round(math.log10(times["smote"] / extra["smote_sf0.01"]), 2)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "extra": extra, "sf": sf, "cpus": int(os.environ.get("BENCH_CPUS", "8"))}))
    spark.stop()


if __name__ == "__main__":
    main()
