"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the median of three runs
after one that warms up the session."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tributary import queries

HEADLINE = ["bucket_docs_by_customer", "bucket_checkpoint_all_orders", "multi_query_bucket_union", "param_lookup_semi_join", "cdc_current_state", "cdc_bucket_effects", "cdc_superseded_checkpoint", "snapshot_pages", "delta_pages", "put_remove_checksums"]

RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
