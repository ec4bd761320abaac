"""Registered queries against their SQL. A spread of them by default, all of them with JOBSIGHT_ALL=1."""

import os
from pathlib import Path

import pytest
from check_oracles import compare, duck

from jobsight.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("JOBSIGHT_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")

SPREAD = [
    "agg_03_fleet_summary_by_name",
    "agg_05_common_issues",
    "agg_06_findings_by_severity",
    "agg_13_compare_runs_of_user",
    "agg_24_word_count",
    "cost_02_tier_cost",
    "cost_13_optimize_config",
    "cost_22_cheapest_option",
    "dia_05_job_analysis",
    "dia_14_rule_report",
    "dia_17_compare_runs",
    "flt_11_composite_search",
    "flt_16_paged_jobs",
    "join_05_fitting_instances",
    "join_13_salted_join",
    "rec_07_top_weighted_similarity",
    "rec_09_similarity_recommendation",
    "set_04_merged_rule_configs",
    "snk_01_insert_counts",
    "snk_02_canonical_rows",
    "src_06_application_record",
    "src_07_history_applications",
    "src_12_cost_split",
    "src_18_job_cost",
    "str_01_latest_metrics",
    "str_12_health_windows",
    "tun_01_session_starts",
    "tun_02_session_outcome",
    "tun_09_change_log",
    "tun_13_learned_recommendation",
    "win_09_running_improvement",
    "win_13_cooldown_alerts",
]
NAMES = list(QUERIES) if os.environ.get("JOBSIGHT_ALL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
