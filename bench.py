"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pairs_time",
    "pairs_window",
    "cov_weight",
    "cov_topk",
    "click2click_covisit_1hour",
    "covisit_items_1hour",
    "covisit_items_window_size5_v3",
    "covisit_bigram_v2",
    "sess_basic",
    "sess_gaps",
    "item_sessions",
    "item_ratios",
    "item_rating",
    "item_transition",
    "w_range_frame",
    "w_row_number",
    "si_counts",
    "si_latest",
    "set_union_distinct",
    "join_assemble",
    "knn_items",
    "topk_list",
    "bl_reciprocal",
    "ev_recall",
    "ds_neg_sample",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from registry.catalogue import QUERIES
    from sessionrank.settings import configure

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        configure(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sess_span"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}  # every query derives its own log and is charged for it
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
