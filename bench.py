"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then once for the clock, its result going
to the no-op sink, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "dia_05_job_analysis",
    "dia_14_rule_report",
    "agg_06_findings_by_severity",
    "agg_03_fleet_summary_by_name",
    "agg_05_common_issues",
    "agg_13_compare_runs_of_user",
    "agg_15_daily_duration",
    "agg_24_word_count",
    "agg_25_revenue_by_region",
    "flt_11_composite_search",
    "join_13_salted_join",
    "join_15_large_equi_join",
    "dia_17_compare_runs",
    "src_06_application_record",
    "cost_13_optimize_config",
    "cost_22_cheapest_option",
    "rec_07_top_weighted_similarity",
    "rec_09_similarity_recommendation",
    "tun_02_session_outcome",
    "win_02_slowest_stages",
    "win_13_cooldown_alerts",
    "agg_09_learned_patterns",
    "str_12_health_windows",
]


def main() -> None:
    from jobsight.plans.catalog import QUERIES
    from jobsight.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name[2:]}
        )
    )


if __name__ == "__main__":
    main()
