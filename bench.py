"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed, none
collected) after one warm-up query; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "P00_flagship_label_profile", "P02_missing_report", "P04_duplicate_stats", "P10_distinct_counts",
    "C01_drop_duplicates", "C02_median_imputation", "C13_key_duplicates_flag", "C15_forward_fill",
    "F01_packet_ratio", "F17_port_entropy", "W01_positional_groups", "W02_group_row_count",
    "W12_interarrival_stats", "L01_abs_correlation", "L07_mutual_information",
    "E06_stratified_split_hash", "E10_robust_and_minmax", "V02_weighted_metrics",
    "X06_request_features", "X11_per_ip_profile", "B02_string_profile", "B03_bigram_top100",
    "R07_risk_level", "M05_isolation_forest", "M01_flows_forest", "M01_deep_forest",
    "E09_smote_neighbours",
]


def main() -> None:
    from netprism.plans import catalog
    from netprism.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2)
    catalog.load_all()
    # warm-up (untimed): JVM code generation and JIT, Python workers, Parquet footers
    for k in ("P01_shape", "P00_flagship_label_profile", "B01_byte_profile"):
        catalog.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        runs = []
        for _ in range(repeats):
            t0 = time.time()
            catalog.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        times[k] = round(statistics.median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit()
                      else sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
