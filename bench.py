"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run twice into a no-op sink: `queries` holds the warm seconds, `cold` the first run.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tremolite.plans import catalog  # noqa: E402
from tremolite.session import build_session  # noqa: E402

HEADLINE = ["W01_rolling_anomaly", "A39_lag_correlation", "J03_space_time_window", "P13_isolated_targets", "J06_anti_range_join", "J09_nearest_parent", "G01_stress_map", "A32_roc_auc",
            "A17_sessions", "D03_gap_report", "A38_distribution_summary", "J17_stress_sum", "W02_baseline_30", "W08_window_counts", "G06_feature_matrix"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            t0 = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


main()
