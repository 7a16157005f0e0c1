"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from cloakframe.plans import QUERIES

HEADLINE = [
    "suppress_classes", "lattice_scores", "anonymize_optimum", "kanon_grid", "kl_grid",
    "kfold", "sample_random", "sample_stratified", "sample_balanced", "undersample",
    "certainty", "privacy_metrics_grid", "target_count_stats", "classification_report",
    "attribute_risk", "risk_prosecutor", "risk_wildcard", "check_combined", "check_tclose_hier",
    "microagg_median", "q_granularity", "summary_stats", "hipaa_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cloakframe-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["suppress_classes"](spark, sf_dir).count()  # start the session before timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
