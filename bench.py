"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names instead of the default list
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "doc_term_counts",
    "clean_tokens",
    "extract_features",
    "ngrams",
    "chi2_scores",
    "log_odds",
    "stratified_kfold",
    "signifier_signified",
    "coverage_counts",
    "combine_neighbours",
    "knn_cosine",
    "knn_cosine_sparse",
    "multinomial_nb",
    "bernoulli_nb",
    "scores_per_fold",
    "cluster_vectors",
    "svd_fit",
]


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from wordfold.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wordfold-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["doc_term_counts"](spark, sf_dir).limit(1).collect()  # start the JVM and its workers
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
