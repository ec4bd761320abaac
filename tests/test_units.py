"""Scalar expressions and per-run diagnosis on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from jobsight import schemas
from jobsight.functions import similarity as sim
from jobsight.functions import numeric, units
from jobsight.operators import alerts, diagnose, features, feedback, rules, tuning
from jobsight.operators.search import Criteria, matching

BASE = {
    "app_id": "app-1",
    "app_name": "nightly-etl",
    "duration_ms": 600_000,
    "executor_cores": 4,
    "executor_memory_mb": 4096,
    "num_executors": 5,
    "driver_memory_mb": 2048,
    "total_tasks": 40,
    "failed_tasks": 0,
    "total_stages": 4,
    "failed_stages": 0,
    "input_bytes": 50 * 1024**3,
    "output_bytes": 1024**3,
    "shuffle_read_bytes": 0,
    "shuffle_write_bytes": 0,
    "memory_spilled_bytes": 0,
    "disk_spilled_bytes": 0,
    "executor_run_time_ms": 100_000,
    "executor_cpu_time_ms": 80_000,
    "jvm_gc_time_ms": 100,
    "peak_memory_usage": 1024**3,
}


def table(spark, *changes):
    rows = [{**BASE, **c, "app_id": f"app-{i}"} for i, c in enumerate(changes or ({},))]
    df = spark.createDataFrame([schemas_row(r) for r in rows], schemas.APPLICATIONS)
    return schemas.zero_filled(df)


def schemas_row(r):
    return tuple(r.get(f.name) for f in schemas.APPLICATIONS.fields)


def values(spark, expression, *inputs):
    df = spark.createDataFrame([(i,) for i in inputs], "v string")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_memory_strings(spark):
    as_mb = lambda c: units.memory_mb(c, bare_unit="bytes", empty_mb=1024)
    assert values(spark, as_mb, "1g", "2048m", "512k", "1t", "4G", "", None) == [1024, 2048, 0, 1048576, 4096, 1024, 1024]
    assert values(spark, units.memory_bytes, "4g", "512m", "100") == [4 * 1024**3, 512 * 1024**2, 100]
    assert values(spark, units.memory_mb, "4g", "512", "1.5g") == [4096, 512, 1536]
    assert values(spark, units.size_bytes, "10GB", "1.5 tb", "7B", "abc", "12") == [
        10 * 1024**3, int(1.5 * 1024**4), 7, None, None,
    ]


@pytest.mark.parametrize(
    "rule_id,hit",
    [
        ("MEM001", {"disk_spilled_bytes": 1}),
        ("MEM002", {"memory_spilled_bytes": 6 * 1024**3}),
        ("SHUFFLE001", {"shuffle_write_bytes": 251 * 1024**3}),
        ("PARTITION001", {"num_executors": 50}),
        ("GC001", {"jvm_gc_time_ms": 61_000}),
        ("SKEW001", {"failed_tasks": 3}),
        ("IO001", {"total_tasks": 200, "input_bytes": 1024**3}),
    ],
)
def test_rules_fire_and_stay_quiet(spark, rule_id, hit):
    quiet = {"num_executors": 25}  # 25 x 4 x 2 = 200 partitions, which is the default
    found = rules.evaluate(table(spark, quiet, {**quiet, **hit})).filter(F.col("rule_id") == rule_id).collect()
    assert [r["app_id"] for r in found] == ["app-1"]


def test_memory_rule_texts_and_configs(spark):
    row = rules.report(table(spark, {"disk_spilled_bytes": 2 * 1024**3, "num_executors": 25})).first()
    assert (row["critical"], row["warnings"], row["health_score"]) == (1, 0, 70.0)
    assert row["spark_configs"] == {"spark.executor.memory": "6144m"}
    assert row["recommended_executor_memory_mb"] == 6144
    assert row["findings"][0]["description"].startswith("Job spilled 2.00 GB to disk/memory.")


def test_later_rule_wins_a_shared_setting(spark):
    def fixed(name, value):
        return rules.Rule(name, name, rules.INFO, applies=lambda: F.lit(True), spark_configs=lambda: {"k": F.lit(value)})

    row = rules.report(table(spark), [fixed("A", "1"), fixed("B", "2")]).first()
    assert row["spark_configs"] == {"k": "2"}


def test_a_null_predicate_does_not_fire(spark):
    odd = rules.Rule("X", "x", rules.INFO, applies=lambda: F.lit(None).cast("boolean"))
    assert rules.evaluate(table(spark), [odd]).count() == 0


def test_bottlenecks_and_health(spark):
    rows = table(
        spark,
        {"executor_cpu_time_ms": 1_900_000},
        {"failed_tasks": 40, "failed_stages": 5, "disk_spilled_bytes": 50 * 1024**3, "jvm_gc_time_ms": 90_000},
        {"input_bytes": 0, "duration_ms": 0, "executor_run_time_ms": 0, "total_tasks": 0},
    )
    out = diagnose.analyze(rows).orderBy("app_id").collect()
    assert "CPU_BOUND" in out[0]["bottlenecks"] and out[0]["health_score"] == 1.0
    assert out[1]["health_score"] == pytest.approx(1 - 0.3 - 0.2 - 0.15 - 0.2)
    assert {"GC_OVERHEAD", "MEMORY_PRESSURE"} <= set(out[1]["bottlenecks"])
    assert out[2]["bottlenecks"] == [] and out[2]["resource_efficiency"]["shuffle_efficiency"] == 1.0


def similarity(spark, a, b, weights=None):
    fields = (
        "input_bytes long, app_name string, total_stages long, num_executors int, executor_cores int,"
        " executor_memory_mb int, shuffle_write_bytes long, output_bytes long"
    )
    names = [f.split()[0] for f in fields.split(",")]
    pick = lambda r: tuple(r.get(n) for n in names)
    df = spark.createDataFrame([(pick(a), pick(b))], f"a struct<{fields.replace(' ', ':').replace(',:', ',')}>, b struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    return df.select(sim.weighted_similarity("a", "b", weights)).first()[0]


def test_similarity_invariants(spark):
    close = {**BASE, "input_bytes": 45 * 1024**3, "app_name": "nightly-etl-2"}
    far = {**BASE, "input_bytes": 1024, "app_name": "zzz", "num_executors": 100, "output_bytes": 1}
    assert similarity(spark, BASE, BASE) == pytest.approx(1.0)
    assert similarity(spark, BASE, close) == pytest.approx(similarity(spark, close, BASE))
    assert similarity(spark, BASE, close) > similarity(spark, BASE, far)
    # only the dimensions both sides have count
    assert similarity(spark, {"input_bytes": 70}, {**BASE, "input_bytes": 100}) == pytest.approx(0.7)
    assert sum(sim.importance({"a": 2.0, "b": 6.0}).values()) == pytest.approx(1.0)
    assert math.isclose(sum(sim.DEFAULT_WEIGHTS.values()), 1.0)


def test_feedback_direction_and_success(spark):
    rows = [("duration", 100, 80, 0), ("duration", 100, 120, 0), ("throughput", 100, 120, 0), ("cost", 0, 5, 10)]
    df = spark.createDataFrame(rows, "metric_name string, metric_before long, metric_after long, expected_improvement int")
    out = [(round(r["actual_improvement"], 6), r["success"]) for r in feedback.scored(df).collect()]
    assert out == [(20.0, True), (-20.0, False), (20.0, True), (0.0, False)]


def test_condition_operators(spark):
    df = spark.createDataFrame([(o,) for o in ("gt", "gte", "lt", "lte", "eq", "neq", "?")], "o string")
    got = [r[0] for r in df.select(feedback.holds(F.col("o"), F.lit(5.0), F.lit(5.0))).collect()]
    assert got == [False, True, False, True, True, False, False]


def test_confidence_needs_samples(spark):
    df = spark.createDataFrame([(4, 4), (5, 5), (20, 20), (15, 30)], "s long, n long")
    got = [r[0] for r in df.select(feedback.confidence(F.col("s"), F.col("n"))).collect()]
    assert got == pytest.approx([0.0, 0.25, 1.0, 0.5])


def test_alert_messages(spark):
    rules_df = alerts.rule_table(spark)
    points = spark.createDataFrame([("a", 1, "jvm_gc_time_percent", 12.34), ("a", 2, "task_failure_rate", 0.25)],
                                   "app_id string, event_id long, metric_name string, value double").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    out = {r["rule"]: r["message"] for r in alerts.with_texts(alerts.triggers(points, rules_df)).collect()}
    assert out["high_gc_time"] == "GC time is 12.3%, exceeding 10.0% threshold"
    assert out["high_task_failure_rate"] == "Task failure rate is 25.0%, exceeding 5.0%"


def test_config_validation(spark):
    rows = [
        ("spark.executor.memory", 100.0, None), ("spark.executor.memory", 512.0, None), ("spark.executor.cores", None, None),
        ("spark.shuffle.compress", 1.0, None), ("spark.shuffle.compress", None, False), ("my.own", None, None),
        ("spark.memory.fraction", 0.96, None),
    ]
    df = spark.createDataFrame(rows, "parameter string, number double, flag boolean").coalesce(1)
    checked = tuning.validate(df.withColumn("i", F.monotonically_increasing_id()), tuning.constraints(spark))
    assert [r["valid"] for r in checked.orderBy("i").collect()] == [False, True, False, False, True, True, False]


def test_null_failures_count_as_success_only_in_the_loose_search(spark):
    rows = table(spark).withColumn("failed_tasks", F.lit(None).cast("long"))
    assert matching(rows, Criteria(successful_only=True)).count() == 1
    from jobsight.operators.search import by_input_range

    assert by_input_range(rows, 0, 10**15).count() == 0


def test_numbers_in_texts_are_rounded_half_even_on_the_double(spark):
    values = [0.125, 0.375, 2.5, 12.35, 1234567.891, 0.05, -0.04, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(numeric.fixed("v", 2), numeric.fixed("v", 1), numeric.fixed("v", 0)).collect()
    assert [tuple(r) for r in got] == [(f"{v:.2f}", f"{v:.1f}", f"{v:.0f}") for v in values]


def test_features_without_a_number_are_zero_and_statistics_are_not_collected(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(features.finite(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 1.5, None]
    matrix = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "app_id string, num_tasks double, num_stages double")
    names = ["num_tasks", "num_stages"]
    for method, want in {"standard": [-1.0, 1.0], "minmax": [0.0, 1.0]}.items():
        got = features.transform(matrix, features.fit(matrix, names), method, names).orderBy("app_id").collect()
        assert [r["num_tasks"] for r in got] == want
        assert [r["num_stages"] for r in got] == [0.0, 0.0]


def test_weights_in_columns_become_shares(spark):
    df = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0)], "a double, b double")
    shares = sim.importance({"a": F.col("a"), "b": F.col("b")})
    assert [tuple(r) for r in df.select(shares["a"], shares["b"]).collect()] == [(0.75, 0.25), (0.0, 0.0)]
    assert sim.importance({"a": 3.0, "b": 1.0}) == {"a": 0.75, "b": 0.25}
