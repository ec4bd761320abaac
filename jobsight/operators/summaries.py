"""Fleet summaries and report aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even, long_sum, mean_of, share, to_gib
from jobsight.operators import diagnose
from jobsight.operators.ordered import exact_median


def statistics(apps: DataFrame) -> DataFrame:
    return apps.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.coalesce(mean_of("duration_ms"), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(long_sum("input_bytes"), F.lit(0)).alias("total_input_bytes"),
        F.coalesce(long_sum("output_bytes"), F.lit(0)).alias("total_output_bytes"),
    )


def runs_per_name(apps: DataFrame) -> DataFrame:
    return apps.filter(F.col("app_name") != "").groupBy("app_name").agg(F.count(F.lit(1)).alias("runs"))


def fleet_summary(jobs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Durations (non-zero ones), volumes, success rate and mean efficiencies, per group or over all."""
    base = diagnose.with_efficiency(jobs)
    timed = F.nullif(F.col("duration_ms"), F.lit(0))
    tasks, failed = F.sum("total_tasks"), F.sum("failed_tasks")
    aggs = [
        F.count(F.lit(1)).alias("total_jobs"),
        F.coalesce(mean_of(timed), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.min(timed), F.lit(0)).alias("min_duration_ms"),
        F.coalesce(F.max(timed), F.lit(0)).alias("max_duration_ms"),
        F.coalesce(F.stddev_samp(timed), F.lit(0.0)).alias("std_duration_ms"),
        long_sum("input_bytes").alias("total_input_bytes"),
        long_sum("output_bytes").alias("total_output_bytes"),
        mean_of("input_bytes").alias("avg_input_bytes"),
        mean_of("output_bytes").alias("avg_output_bytes"),
        F.when(tasks > 0, half_even((tasks - failed).cast("double") / tasks, 4))
        .otherwise(F.lit(1.0))
        .alias("task_success_rate"),
    ] + [
        # efficiencies carry three places, so their sum is exact in whole thousandths
        (mean_of(F.rint(F.col(c) * 1000).cast("long")) / 1000).alias(f"avg_{c}")
        for c in ("cpu_efficiency", "memory_efficiency", "io_efficiency", "overall_efficiency")
    ]
    medians = exact_median(jobs.withColumn("_timed", timed), "_timed", groups).withColumnRenamed(
        "median", "median_duration_ms"
    )
    if groups:
        out = base.groupBy(*groups).agg(*aggs).join(medians, list(groups), "left")
    else:
        out = (
            base.agg(*aggs)
            .withColumn("_one", F.lit(1))
            .join(medians.withColumn("_one", F.lit(1)), "_one", "left")
            .drop("_one")
        )
    return out.fillna(0.0, ["median_duration_ms"])


def common_issues(jobs: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent issue types with the percent of all runs that show them."""
    counted = jobs.agg(
        F.count(F.lit(1)).alias("_jobs"),
        *[F.count_if(found).alias(kind) for kind, found in diagnose.issue_conditions().items()],
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("count")) for k in diagnose.issue_conditions()])
    return (
        counted.select("_jobs", F.inline(kinds))
        .filter(F.col("count") > 0)
        .select("type", "count", (F.col("count") / F.col("_jobs") * 100).alias("percentage"))
        .orderBy(F.desc("count"), "type")
        .limit(k)
    )


def compare_groups(jobs: DataFrame, group: str) -> DataFrame:
    """Fastest, slowest, most and least efficient run of each comparison group, with three hints."""
    seconds = F.col("duration_ms") / 1000.0
    sized = (F.col("duration_ms") > 0) & (F.col("input_bytes") > 0)
    hours = F.col("num_executors") * F.col("duration_ms") / F.lit(3600000.0)
    spilled = F.col("disk_spilled_bytes") + F.col("memory_spilled_bytes")
    rows = jobs.withColumns(
        {
            "throughput": F.when(sized, to_gib("input_bytes") / seconds).otherwise(F.lit(0.0)),
            "per_executor_hour": F.when(sized & (hours > 0), to_gib("input_bytes") / hours).otherwise(F.lit(0.0)),
            "spills": (F.col("input_bytes") > 0) & (spilled > 0),
        }
    )
    timed = F.col("duration_ms") > 0
    moving = F.col("throughput") > 0

    # ties go to the smallest id
    def first(ok: Column, value: Column) -> Column:
        return F.min(F.when(ok, F.struct(value.alias("v"), F.col("app_id").alias("app_id"))))

    summary = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("compared_count"),
        first(timed, F.col("duration_ms")).alias("_fast"),
        first(timed, -F.col("duration_ms")).alias("_slow"),
        first(moving, -F.col("throughput")).alias("_best"),
        first(moving, F.col("throughput")).alias("_worst"),
        F.count_if("spills").alias("spilling"),
        F.count_if(F.col("failed_tasks") > 0).alias("failing"),
        mean_of("executor_memory_mb").alias("avg_memory"),
        F.max("per_executor_hour").alias("best_gb_per_executor_hour"),
    )
    # memory of the runs within 80 % of the best throughput needs the best one first
    high = (
        rows.join(summary.select(group, (-F.col("_best.v")).alias("_top")), group)
        .filter(moving & (F.col("throughput") > F.col("_top") * 0.8))
        .groupBy(group)
        .agg(mean_of("executor_memory_mb").alias("high_throughput_memory"))
    )
    n = F.col("compared_count")
    return (
        summary.join(high, group, "left")
        .withColumns(
            {
                "fastest": F.col("_fast.app_id"),
                "fastest_ms": F.col("_fast.v"),
                "slowest": F.col("_slow.app_id"),
                "slowest_ms": -F.col("_slow.v"),
                "most_efficient": F.col("_best.app_id"),
                "best_throughput_gbps": half_even(-F.col("_best.v"), 3),
                "least_efficient": F.col("_worst.app_id"),
                "worst_throughput_gbps": half_even(F.col("_worst.v"), 3),
                "spill_hint": (F.col("spilling") > 0) & (F.col("spilling") < n),
                "reliability_hint": (F.col("failing") > 0) & (F.col("failing") < n),
                "memory_hint_mb": F.when(
                    F.col("high_throughput_memory") < F.col("avg_memory") * 0.8,
                    F.floor("high_throughput_memory").cast("long"),
                ),
            }
        )
        .drop("_fast", "_slow", "_best", "_worst", "high_throughput_memory", "avg_memory")
    )


def daily(apps: DataFrame) -> DataFrame:
    """The charts of a day: duration, success rate, cost at 0.10 per executor hour, volumes."""
    executor_ms = F.sum(F.col("num_executors").cast("long") * F.col("duration_ms"))
    return apps.groupBy(F.date_format("start_time", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"),
        half_even(mean_of("duration_ms") / 60000, 2).alias("avg_minutes"),
        half_even(share(F.col("status") == "completed") * 100, 1).alias("success_percent"),
        half_even(executor_ms.cast("double") / 3600000 * F.lit(0.1), 2).alias("cost"),
        half_even(to_gib(F.sum("input_bytes")), 2).alias("input_gb"),
        half_even(to_gib(F.sum("output_bytes")), 2).alias("output_gb"),
    )


def status_counts(apps: DataFrame) -> DataFrame:
    return apps.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def dashboard(apps: DataFrame) -> DataFrame:
    return apps.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("status") == "completed").alias("successful_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.coalesce(mean_of(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))), F.lit(0.0)).alias("avg_duration_ms"),
    )
