"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cutline.plans.queries import QUERIES  # noqa: E402
from cutline.session import local_session  # noqa: E402

HEADLINE = [
    "scan_parquet", "roundtrip_partitioned", "ingest_audit", "partition_counts", "clean_newlines",
    "jee_per_year", "jee_multi_year", "jee_features", "neet_features", "kcet_features",
    "comedk_features", "history_stats", "fill_median", "vocab_unknown", "unpivot_courses",
    "sample_pos_neg", "split_hash", "split_stratified", "eval_regression", "eval_auc",
    "eval_classification", "request_dedup", "jee_candidate_match", "kcet_grid", "tier_order",
    "tier_topk_desc", "tier_topk_asc", "threshold_topn", "request_summary", "train_regressor",
]


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
