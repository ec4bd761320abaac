"""Live state of applications, as batch jobs over the landed points and as streaming aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobsight.operators.ordered import with_previous

# Metric history keeps a thousand points and one hour
MAX_POINTS, MAX_AGE = 1000, "1 hour"


def latest_metrics(points: DataFrame) -> DataFrame:
    """Latest value of every metric of every application; batch or stream."""
    return points.groupBy("app_id", "metric_name").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("last_updated")
    )


def registrations(points: DataFrame, key: str) -> DataFrame:
    """One started event per application, at its first sight; batch or stream."""
    return points.select(key).dropDuplicates([key]).withColumn("event", F.lit("application_started"))


def latest_status(updates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Partial updates folded: a field keeps its last given value. Also the seconds since the first update."""
    place = F.struct("ts", "event_id")
    return updates.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields],
        (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).alias("running_us"),
    )


def status_changes(updates: DataFrame, key: str, block: Column) -> DataFrame:
    """Updates that change the status; a new application is running."""
    given = updates.filter(F.col("status").isNotNull())
    paired = with_previous(given, [key], block, ["ts", "event_id"], ["status"], "before")
    old = F.coalesce("before.status", F.lit("running"))
    return paired.filter(F.col("status") != old).select(
        key, "event_id", old.alias("old_status"), F.col("status").alias("new_status")
    )


def retained_history(points: DataFrame, max_points: int = MAX_POINTS, max_age: str = MAX_AGE) -> DataFrame:
    """Newest points of every metric of every application, by age and number.

    The age filter comes first, so the ranking sees little, and the rank limit cuts before the shuffle.
    """
    keys = ["app_id", "metric_name"]
    last = points.groupBy(*keys).agg(F.max("ts").alias("_now"))
    young = points.join(last, keys).filter(F.col("ts") > F.col("_now") - F.expr(f"INTERVAL {max_age}"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))
    return young.withColumn("_n", place).filter(F.col("_n") <= max_points).drop("_n", "_now")


def history_of(points: DataFrame, app_id: str, metric_name: str, since: str | None = None) -> DataFrame:
    rows = points.filter((F.col("app_id") == app_id) & (F.col("metric_name") == metric_name))
    return rows if since is None else rows.filter(F.col("ts") > F.lit(since).cast("timestamp"))


def live_counters(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count_if(F.coalesce("status", F.lit("running")) == "running").alias("running_apps"),
        F.sum(F.coalesce("active_tasks", F.lit(0))).cast("long").alias("active_tasks"),
        F.sum(F.coalesce("executors", F.lit(0))).cast("long").alias("executors"),
    )


def health_windows(tasks: DataFrame, key: str, ts: str, width: str = "1 day") -> DataFrame:
    """Metrics the alert rules look at, per application and tumbling window; batch or stream."""
    grouped = tasks.groupBy(F.window(ts, width).alias("w"), key).agg(
        F.sum("num_tasks").cast("long").alias("tasks"),
        F.sum("failed_tasks").cast("long").alias("failed"),
        F.sum("run_ms").cast("long").alias("run"),
        F.sum("cpu_ms").cast("long").alias("cpu"),
        F.sum("gc_ms").cast("long").alias("gc"),
        F.sum("input_bytes").cast("long").alias("input"),
        F.sum("memory_spilled_bytes").cast("long").alias("spilled"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return grouped.select(
        F.col("w.start").alias("window_start"),
        key,
        share("failed", "tasks").alias("task_failure_rate"),
        (share("gc", "run") * 100).alias("jvm_gc_time_percent"),
        (share("cpu", "run") * 100).alias("cpu_utilization"),
        share("spilled", "input").alias("memory_spill_ratio"),
    )
