"""Headline queries on the given tables; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from hosttrace.checks import catalogue, learning, telemetry
from hosttrace.session import release

HEADLINE = [
    "a1_process_features", "a4_prefix_features", "a6_sibling_context", "a7_tactic_counts", "a8_process_network",
    "a9_beacon_regularity", "a13_sensor_gap", "a21_label_audit", "f8_evidence", "g1_depth_and_root_image",
    "g2_label_by_lineage", "g5_lineage_root", "j2_enrich_with_pid_fallback", "j5_one_to_one_match", "m18_benign_threshold",
    "m21_roc_auc", "p4_drop_repeats", "w5_window_alerts",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("hosttrace-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["p6_unkeyed_count"](spark, sf_dir).collect()  # start the engine before the clock
    times = {}
    for name in HEADLINE:
        telemetry.forget()  # every query pays for its own projection of the events
        learning.forget()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
