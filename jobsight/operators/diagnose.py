"""Per-run diagnosis: efficiency, bottlenecks, issues and health, one projection over the whole table.

Every function expects the zero-filled application table (``schemas.zero_filled``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import MIB, collected, half_even, ratio, to_gib

# Thresholds of the diagnosis
HIGH_GC_RATIO = 0.1
HIGH_SHUFFLE_RATIO = 0.5
HIGH_SPILL_RATIO = 0.05
LOW_CPU_UTILIZATION = 0.3
HIGH_CPU_UTILIZATION = 0.85
LOW_PARALLELISM_RATIO = 0.5
EXCESSIVE_TASK_RATIO = 10
IDEAL_BYTES_PER_MS = 100 * MIB / 1000

EFFICIENCIES = ["cpu_efficiency", "memory_efficiency", "io_efficiency", "shuffle_efficiency", "overall_efficiency"]


def cores() -> Column:
    return F.col("num_executors").cast("long") * F.col("executor_cores").cast("long")


def cpu_share() -> Column:
    return ratio("executor_cpu_time_ms", F.col("executor_run_time_ms") * cores())


def gc_share() -> Column:
    return ratio("jvm_gc_time_ms", "executor_run_time_ms")


def per_input(amount: Column) -> Column:
    """An amount of bytes relative to the input; 0 without input."""
    return ratio(amount, "input_bytes")


def failure_share() -> Column:
    return ratio("failed_tasks", "total_tasks")


def shuffled() -> Column:
    return F.col("shuffle_read_bytes") + F.col("shuffle_write_bytes")


def efficiency() -> dict[str, Column]:
    """The five efficiencies, rounded to three places, plus CPU time per unit of task time."""
    one = F.lit(1.0)
    allocated = F.col("executor_memory_mb").cast("long") * MIB * F.col("num_executors").cast("long")
    moved = F.col("input_bytes") + F.col("output_bytes")
    parts = {
        "cpu_efficiency": F.least(one, cpu_share()),
        "memory_efficiency": F.least(one, ratio("peak_memory_usage", allocated)),
        "io_efficiency": F.least(one, ratio(moved, "duration_ms") / F.lit(IDEAL_BYTES_PER_MS)),
        "shuffle_efficiency": one - F.least(one, per_input(shuffled())),
    }
    cpu, mem, io, shuffle = parts.values()
    out = {name: half_even(value, 3) for name, value in parts.items()}
    out["overall_efficiency"] = half_even((cpu + mem + io + shuffle) / F.lit(4.0), 3)
    out["cpu_efficiency_task"] = half_even(F.least(one, ratio("executor_cpu_time_ms", "executor_run_time_ms")), 3)
    return out


def with_efficiency(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns(efficiency())


def bottlenecks() -> Column:
    """Array of labels."""
    ran = F.col("executor_run_time_ms") > 0
    spilled = F.col("memory_spilled_bytes") + F.col("disk_spilled_bytes")
    ideal = cores() * 2
    load = ratio("total_tasks", ideal)
    counted = (F.col("total_tasks") > 0) & (ideal > 0)
    return collected(
        (ran & (cpu_share() > HIGH_CPU_UTILIZATION), F.lit("CPU_BOUND")),
        (ran & (cpu_share() < LOW_CPU_UTILIZATION), F.lit("CPU_UNDERUTILIZED")),
        (per_input(spilled) > HIGH_SPILL_RATIO, F.lit("MEMORY_PRESSURE")),
        (gc_share() > HIGH_GC_RATIO, F.lit("GC_OVERHEAD")),
        (per_input(shuffled()) > HIGH_SHUFFLE_RATIO, F.lit("SHUFFLE_HEAVY")),
        (counted & (load < LOW_PARALLELISM_RATIO), F.lit("LOW_PARALLELISM")),
        (counted & (load > EXCESSIVE_TASK_RATIO), F.lit("EXCESSIVE_TASKS")),
    )


def _high_if(condition: Column) -> Column:
    return F.when(condition, "HIGH").otherwise("MEDIUM")


def issue_conditions() -> dict[str, Column]:
    """Issue type -> when it is found, in order."""
    return {
        "DATA_SKEW": per_input(F.col("shuffle_write_bytes")) > 2.0,
        "DISK_SPILL": F.col("disk_spilled_bytes") > 0,
        "MEMORY_SPILL": F.col("memory_spilled_bytes") > 0,
        "TASK_FAILURES": F.col("failed_tasks") > 0,
        "STAGE_FAILURES": F.col("failed_stages") > 0,
        "LOW_PARALLELISM": (F.col("total_tasks") > 0) & (F.col("total_tasks") < cores()),
        "HIGH_GC_TIME": gc_share() > HIGH_GC_RATIO,
    }


def issues() -> Column:
    """Array of struct(type, severity, description, recommendation)."""
    growth = per_input(F.col("shuffle_write_bytes"))
    disk_gb, memory_gb = to_gib("disk_spilled_bytes"), to_gib("memory_spilled_bytes")
    # Texts of the issues
    details = {
        "DATA_SKEW": (
            _high_if(growth > 5.0),
            F.format_string("High data amplification (%.1fx) may indicate data skew", growth),
            "Consider salting keys or repartitioning data",
        ),
        "DISK_SPILL": (
            _high_if(disk_gb > 10),
            F.format_string("Spilled %.2f GB to disk due to memory pressure", disk_gb),
            "Increase executor memory or reduce partition size",
        ),
        "MEMORY_SPILL": (
            F.lit("MEDIUM"),
            F.format_string("Spilled %.2f GB from memory", memory_gb),
            "Increase spark.memory.fraction or executor memory",
        ),
        "TASK_FAILURES": (
            _high_if(failure_share() > 0.05),
            F.format_string("%d tasks failed (%.1f%% failure rate)", "failed_tasks", failure_share() * 100),
            "Check executor logs for OOM errors or data issues",
        ),
        "STAGE_FAILURES": (
            F.lit("HIGH"),
            F.format_string("%d stages failed", "failed_stages"),
            "Review stage details for root cause",
        ),
        "LOW_PARALLELISM": (
            F.lit("MEDIUM"),
            F.format_string("Only %d tasks for %d cores", F.col("total_tasks"), cores()),
            "Increase partition count with repartition() or coalesce()",
        ),
        "HIGH_GC_TIME": (
            F.when(gc_share() < 0.2, "MEDIUM").otherwise("HIGH"),
            F.format_string("GC time is %.1f%% of execution time", gc_share() * 100),
            "Increase executor memory or tune GC settings",
        ),
    }

    def record(kind: str) -> Column:
        severity, description, advice = details[kind]
        return F.struct(
            F.lit(kind).alias("type"),
            severity.alias("severity"),
            description.alias("description"),
            F.lit(advice).alias("recommendation"),
        )

    return collected(*[(found, record(kind)) for kind, found in issue_conditions().items()])


def health_score() -> Column:
    """1 minus capped penalties for failures, spill, GC and failed stages; never below 0."""
    gc_penalty = F.when(gc_share() > HIGH_GC_RATIO, F.least(F.lit(0.15), gc_share() * 0.5)).otherwise(F.lit(0.0))
    score = (
        F.lit(1.0)
        - F.least(F.lit(0.3), failure_share() * 3.0)
        - F.least(F.lit(0.2), per_input(F.col("disk_spilled_bytes")) * 0.5)
        - gc_penalty
        - F.least(F.lit(0.2), F.col("failed_stages") * F.lit(0.1))
    )
    return F.greatest(F.lit(0.0), half_even(score, 3))


def analyze(jobs: DataFrame) -> DataFrame:
    """The whole analysis record of every run."""
    return jobs.select(
        "app_id",
        "app_name",
        "duration_ms",
        F.struct(*[v.alias(k) for k, v in efficiency().items()]).alias("resource_efficiency"),
        bottlenecks().alias("bottlenecks"),
        issues().alias("issues"),
        health_score().alias("health_score"),
    )


def suggestions(jobs: DataFrame) -> DataFrame:
    """One row per issue of a run, as shown beside the analysis."""
    return analyze(jobs).select(
        "app_id",
        "health_score",
        F.inline("issues").alias("issue", "severity", "description", "recommendation"),
    )


def quick_check(jobs: DataFrame) -> DataFrame:
    """The four short checks: disk spill, GC, failed tasks, shuffle volume."""
    shuffle_ratio = per_input(F.col("shuffle_write_bytes"))
    found = collected(
        (F.col("disk_spilled_bytes") > 0, F.lit("disk_spill")),
        (gc_share() > HIGH_GC_RATIO, F.lit("high_gc")),
        (F.col("failed_tasks") > 0, F.lit("task_failures")),
        (shuffle_ratio > HIGH_SHUFFLE_RATIO, F.lit("high_shuffle")),
    )
    return jobs.select(
        "app_id",
        (F.col("duration_ms") / 60000.0).alias("duration_min"),
        to_gib("input_bytes").alias("input_gb"),
        to_gib("shuffle_write_bytes").alias("shuffle_gb"),
        found.alias("findings"),
        (F.size(found) == 0).alias("well_optimized"),
    )


RESOURCE_FIELDS = ["num_executors", "executor_cores", "executor_memory_mb", "driver_memory_mb"]
PERFORMANCE_FIELDS = [
    "duration_ms", "total_tasks", "input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
]


def compare_pairs(pairs: DataFrame, a: str = "job1", b: str = "job2") -> DataFrame:
    """Differences of two runs held as structs ``a`` and ``b`` of a row, with hints on which one to follow.

    The structs carry the fields of the job table and the efficiency columns.
    """

    def pct(diff: Column, base: Column) -> Column:
        return F.when(base != 0, half_even(diff / base * 100, 1)).otherwise(F.lit(0.0))

    def side(s: str, f: str) -> Column:
        return F.col(f"{s}.{f}").cast("long")

    out: dict[str, Column] = {}
    for f in RESOURCE_FIELDS:
        x, y = side(a, f), side(b, f)
        diff = F.when((x != 0) & (y != 0), y - x).otherwise(F.lit(0).cast("long"))
        out[f"{f}_diff"], out[f"{f}_pct"] = diff, pct(diff, x)
    for f in PERFORMANCE_FIELDS:
        x, y = side(a, f), side(b, f)
        out[f"{f}_diff"], out[f"{f}_pct"] = y - x, pct(y - x, x)
    for f in EFFICIENCIES:
        out[f"{f}_diff"] = half_even(F.col(f"{b}.{f}") - F.col(f"{a}.{f}"), 3)
    d1, d2 = side(a, "duration_ms"), side(b, "duration_ms")
    e1, e2 = F.col(f"{a}.overall_efficiency"), F.col(f"{b}.overall_efficiency")
    timed = (d1 > 0) & (d2 > 0)
    out["faster_hint"] = F.when(timed & (d2 < d1 * 0.8), "job2").when(timed & (d1 < d2 * 0.8), "job1")
    out["faster_percent"] = F.when(timed & (d2 < d1 * 0.8), half_even((d1 - d2) / d1 * 100)).when(
        timed & (d1 < d2 * 0.8), half_even((d2 - d1) / d2 * 100)
    )
    out["efficient_hint"] = F.when(e2 > e1 + 0.1, "job2").when(e1 > e2 + 0.1, "job1")
    return pairs.select(
        F.col(f"{a}.app_id").alias("job1_id"),
        F.col(f"{b}.app_id").alias("job2_id"),
        *[v.alias(k) for k, v in out.items()],
    )


