"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tracewell import queries

NAMES = ("pred_cidr", "pred_glob", "req_exists", "thr_count", "thr_distinct", "parent_asof", "descendant_d4", "chain_abc", "seq_tolerance", "seq_within", "match_first", "suppress", "rate_limit", "snap_diff_process", "latency_hist")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries.QUERIES["tab_counts"](spark, folder).collect()  # starts the session
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(4):  # one to warm up, then the median of three
            began = time.perf_counter()
            queries.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
