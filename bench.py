"""Time the queries on one table folder and print one JSON line.

    BENCH_SF_DIR   folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores            (default 8)
    BENCH_QUERIES  comma-separated subset (default: the headline queries; "all" for every query)

Two untimed queries come first, so that no query pays for starting the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.queries import QUERIES  # noqa: E402
from workload.session import local_session  # noqa: E402

HEADLINE = [
    "missing_by_column", "duplicate_count_first", "drop_duplicates", "numeric_column_stats", "outlier_iqr_counts",
    "outlier_zscore", "distinct_counts", "distinct_texts", "top_values", "category_counts", "extreme_magnitudes",
    "date_string_columns", "impute_median", "impute_mode", "outlier_cap", "check_summary", "findings", "clean_customer",
    "clean_orders_cap", "csv_round_trip", "stream_replay", "token_budget_prefix", "parse_replies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(QUERIES) if chosen == "all" else chosen.split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    for name in ("missing_by_column", "duplicate_count_none"):
        QUERIES[name](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:32} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
