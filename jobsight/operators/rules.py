"""Diagnosis rules as column expressions.

A rule is a predicate with texts and a config map, all of them columns of the
job table, so a set of rules is one projection. A new rule is a new ``Rule``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import MIB, collected, ratio, sum_of, to_gib

CRITICAL, WARNING, INFO = "critical", "warning", "info"


def _none() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Rule:
    """``applies`` is true on the rows the rule reports; null counts as false."""

    rule_id: str
    title: str
    severity: str
    applies: Callable[[], Column]
    description: Callable[[], Column] = _none
    current_value: Callable[[], Column] = _none
    recommended_value: Callable[[], Column] = _none
    expected_improvement: str | None = None
    spark_configs: Callable[[], dict[str, Column]] = field(default=dict)
    executor_memory_mb: Callable[[], Column] | None = None
    driver_memory_factor: float | None = None

    def finding(self) -> Column:
        configs = self.spark_configs()
        entries = [x for k, v in configs.items() for x in (F.lit(k), v)]
        config_map = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
        return F.struct(
            F.lit(self.rule_id).alias("rule_id"),
            F.lit(self.title).alias("title"),
            F.lit(self.severity).alias("severity"),
            self.description().alias("description"),
            self.current_value().alias("current_value"),
            self.recommended_value().alias("recommended_value"),
            F.lit(self.expected_improvement).cast("string").alias("expected_improvement"),
            config_map.alias("spark_configs"),
        )


def _spilled() -> Column:
    return F.col("disk_spilled_bytes") + F.col("memory_spilled_bytes")


def _half_more_memory() -> Column:
    return F.floor(F.col("executor_memory_mb") * 1.5).cast("long")


def _target_partitions() -> Column:
    return F.col("num_executors").cast("long") * F.col("executor_cores").cast("long") * 2


def recommended_partitions() -> Column:
    """Two per core, doubled up to 2000 for large inputs, halved down to 20 for small ones."""
    gb = to_gib("input_bytes")
    target = _target_partitions()
    return (
        F.when(gb > 100, F.least(target * 2, F.lit(2000)))
        .when(gb > 10, target)
        .otherwise(F.greatest(F.floor(target / 2).cast("long"), F.lit(20)))
    )


def _gc_percent() -> Column:
    return ratio("jvm_gc_time_ms", "duration_ms") * 100


def _text(value: str) -> Callable[[], Column]:
    return lambda: F.lit(value)


# Identifiers, titles, thresholds and texts of the built-in rules
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule(
        "MEM001",
        "Memory Spilling Detected",
        CRITICAL,
        applies=lambda: _spilled() > 0,
        description=lambda: F.format_string(
            "Job spilled %.2f GB to disk/memory. This indicates insufficient executor memory"
            " and will severely impact performance.",
            to_gib(_spilled()),
        ),
        current_value=lambda: F.format_string("%d MB", F.col("executor_memory_mb")),
        recommended_value=lambda: F.format_string("%d MB", _half_more_memory()),
        expected_improvement="20-50% faster execution, more stable performance",
        spark_configs=lambda: {"spark.executor.memory": F.format_string("%dm", _half_more_memory())},
        executor_memory_mb=_half_more_memory,
    ),
    Rule(
        "MEM002",
        "Memory Fraction Optimization",
        WARNING,
        applies=lambda: (F.col("input_bytes") > 0) & (F.col("memory_spilled_bytes") > F.col("input_bytes") * 0.1),
        description=_text(
            "Significant memory spilling detected. Increasing memory fraction for execution can help."
        ),
        current_value=_text("Default (0.6)"),
        recommended_value=_text("0.8"),
        expected_improvement="Reduced spilling, 10-20% performance gain",
        spark_configs=lambda: {
            "spark.memory.fraction": F.lit("0.8"),
            "spark.memory.storageFraction": F.lit("0.2"),
        },
    ),
    Rule(
        "SHUFFLE001",
        "Excessive Shuffle Detected",
        CRITICAL,
        applies=lambda: (F.col("input_bytes") > 0) & (F.col("shuffle_write_bytes") > F.col("input_bytes") * 5),
        description=lambda: F.format_string(
            "Shuffle write (%.2f GB) is %.1fx the input size (%.2f GB)."
            " Consider using broadcast joins for smaller tables.",
            to_gib("shuffle_write_bytes"),
            ratio("shuffle_write_bytes", "input_bytes"),
            to_gib("input_bytes"),
        ),
        current_value=lambda: F.format_string("%.2f GB shuffled", to_gib("shuffle_write_bytes")),
        recommended_value=_text("Use broadcast joins or repartition"),
        expected_improvement="50-80% reduction in shuffle, significantly faster execution",
        spark_configs=lambda: {"spark.sql.autoBroadcastJoinThreshold": F.lit("104857600")},
        driver_memory_factor=1.2,
    ),
    Rule(
        "PARTITION001",
        "Suboptimal Partition Count",
        WARNING,
        applies=lambda: F.abs(recommended_partitions() - 200) > 50,
        description=lambda: F.format_string(
            "With %d executors and %d cores each, shuffle partitions should be optimized for parallelism.",
            F.col("num_executors"),
            F.col("executor_cores"),
        ),
        current_value=_text("200 (default)"),
        recommended_value=lambda: recommended_partitions().cast("string"),
        expected_improvement="Better parallelism, 10-30% performance gain",
        spark_configs=lambda: {"spark.sql.shuffle.partitions": recommended_partitions().cast("string")},
    ),
    Rule(
        "GC001",
        "High GC Pressure",
        CRITICAL,
        applies=lambda: (F.col("duration_ms") > 0) & (F.col("jvm_gc_time_ms") > F.col("duration_ms") * 0.1),
        description=lambda: F.format_string(
            "GC time is %.1f%% of total execution time. This indicates memory pressure and frequent"
            " garbage collection.",
            _gc_percent(),
        ),
        current_value=lambda: F.format_string("%.1f%% GC time", _gc_percent()),
        recommended_value=_text("< 10% GC time"),
        expected_improvement="15-40% performance improvement",
        spark_configs=lambda: {
            "spark.executor.extraJavaOptions": F.lit("-XX:+UseG1GC -XX:InitiatingHeapOccupancyPercent=35")
        },
    ),
    Rule(
        "SKEW001",
        "Potential Data Skew",
        WARNING,
        applies=lambda: (F.col("total_tasks") > 0) & (F.col("failed_tasks") > F.col("total_tasks") * 0.05),
        description=lambda: F.format_string(
            "%.1f%% task failure rate detected. This often indicates data skew where some partitions"
            " are much larger than others.",
            ratio("failed_tasks", "total_tasks") * 100,
        ),
        current_value=lambda: F.format_string("%d/%d tasks failed", F.col("failed_tasks"), F.col("total_tasks")),
        recommended_value=_text("Add salting or use adaptive execution"),
        expected_improvement="More balanced execution, fewer failures",
        spark_configs=lambda: {
            "spark.sql.adaptive.enabled": F.lit("true"),
            "spark.sql.adaptive.skewJoin.enabled": F.lit("true"),
        },
    ),
    Rule(
        "IO001",
        "Too Many Small Files",
        WARNING,
        applies=lambda: (F.col("total_tasks") > 100)
        & (F.col("input_bytes") > 0)
        & (ratio("input_bytes", "total_tasks") / MIB < 10),
        description=lambda: F.format_string(
            "Job has %d tasks with average input size of %.2f MB. Small files create scheduling overhead"
            " and reduce parallelism.",
            F.col("total_tasks"),
            ratio("input_bytes", "total_tasks") / MIB,
        ),
        current_value=lambda: F.format_string(
            "%d files, %.2f MB avg", F.col("total_tasks"), ratio("input_bytes", "total_tasks") / MIB
        ),
        recommended_value=_text("Coalesce files to 128-256 MB each"),
        expected_improvement="Reduced scheduling overhead, 20-40% faster",
        spark_configs=lambda: {"spark.sql.files.maxPartitionBytes": F.lit(str(256 * MIB))},
    ),
)


def findings(rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Array of the findings of a run, in the order of the rules."""
    return collected(*[(r.applies(), r.finding()) for r in rules])


def evaluate(jobs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, severity: str | None = None) -> DataFrame:
    """One row per run and finding; optionally only one severity."""
    wanted = [r for r in rules if severity is None or r.severity == severity]
    return jobs.select("app_id", "app_name", F.inline(findings(wanted)))


def severity_count(severity: str, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Findings of one severity of a run, counted without building them."""
    return sum_of(*[r.applies() for r in rules if r.severity == severity])


def severity_totals(jobs: DataFrame, group: str, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Findings per severity and group: the runs are counted in place, no finding is built or exploded."""
    return jobs.groupBy(group).agg(
        *[F.sum(severity_count(s, rules)).cast("long").alias(s) for s in (CRITICAL, WARNING, INFO)]
    )


def merge_configs(found: Column) -> Column:
    """Union of the config maps of the findings; the later rule wins a shared key."""
    entries = F.flatten(F.transform(found, lambda f: F.map_entries(f["spark_configs"])))

    def last_of_its_key(e: Column, i: Column) -> Column:
        later = F.slice(entries, i + 2, F.size(entries) + 1)
        return ~F.exists(later, lambda x: x["key"] == e["key"])

    return F.map_from_entries(F.filter(entries, last_of_its_key))


def optimized_memory(rules: Sequence[Rule] = DEFAULT_RULES) -> tuple[Column, Column]:
    """Executor and driver memory after the findings are applied."""
    executor = F.col("executor_memory_mb").cast("long")
    driver = F.col("driver_memory_mb").cast("long")
    for r in rules:
        if r.executor_memory_mb is not None:
            executor = F.when(r.applies(), F.greatest(executor, r.executor_memory_mb())).otherwise(executor)
        if r.driver_memory_factor is not None:
            scaled = F.floor(driver * F.lit(r.driver_memory_factor)).cast("long")
            driver = F.when(r.applies(), scaled).otherwise(driver)
    return executor, driver


def report(jobs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Counts, score, current and advised configuration and the findings of every run."""
    found = F.col("findings")
    counts = {s: severity_count(s, rules) for s in (CRITICAL, WARNING, INFO)}
    score = 100.0 - counts[CRITICAL] * 30.0 - counts[WARNING] * 10.0 - counts[INFO] * 2.0
    executor, driver = optimized_memory(rules)
    return jobs.withColumn("findings", findings(rules)).select(
        "app_id",
        "app_name",
        sum_of(*[r.applies() for r in rules]).alias("total_recommendations"),
        counts[CRITICAL].alias("critical"),
        counts[WARNING].alias("warnings"),
        counts[INFO].alias("info"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("health_score"),
        "num_executors",
        "executor_cores",
        "executor_memory_mb",
        "driver_memory_mb",
        executor.alias("recommended_executor_memory_mb"),
        driver.alias("recommended_driver_memory_mb"),
        merge_configs(found).alias("spark_configs"),
        collected(*[(r.applies(), F.lit(r.rule_id)) for r in rules]).alias("rule_ids"),
        "findings",
    )
