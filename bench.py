"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, ROOT := os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from foldline.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "cigar_pairs", "cigar_validate", "pair_metadata_join", "bidirectional_pairs", "class_hier_counts", "standardizer_fit", "standardize_apply", "examples_per_group_quantiles",
    "bounded_histogram", "nearest_partner", "descriptor10", "superposed_ca_distance", "fsq_states", "centroid_assign", "state_sequences", "joint_counts", "aligned_counts",
    "substitution_matrix", "adjusted_mi", "first_fp_sensitivity", "group_split_hash", "cap_per_alignment_hash",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["joint_counts"](spark, sf).collect()  # starts the JVM's code generation and reads footers
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
