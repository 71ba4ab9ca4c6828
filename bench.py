"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    runs per query, the best one counts (default 2)
Queries write into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mendframe.plans.catalog import QUERIES
from mendframe.session import local_session

HEADLINES = (
    "profile_counts",
    "profile_numeric",
    "profile_median",
    "profile_mode",
    "profile_zscores",
    "key_discovery",
    "detect_null",
    "detect_type_error",
    "detect_constraint",
    "detect_outlier",
    "detect_duplicate",
    "detect_fk_violation",
    "detect_whitespace_documents",
    "detect_category",
    "detect_all_hard",
    "issues_remaining",
    "fix_cells",
    "auto_impute",
    "apply_corrections",
    "repair_in_place",
    "cell_diff",
    "validate_checks",
    "resolution_score",
    "score_hard",
    "sql_group",
    "sql_window",
    "sql_left_join",
    "join_match_rate",
    "dimension_facts",
    "action_rewards",
    "coerce_types",
    "round_trip_csv",
    "round_trip_json",
    "round_trip_parquet",
    "delete_rows",
    "fp_penalty",
    "score_composite",
    "episode_totals",
    "inject_errors",
    "inject_decoy",
    "downstream_ml",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "8g"), app="bench")
    # start the engine on a query that is not timed
    QUERIES["table_preview"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINES:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": RUNS,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
