"""Row shapes: nested job record, display row, submit arguments, ETL columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even, to_gib
from jobsight.functions.units import minutes_seconds


def job_record(apps: DataFrame) -> DataFrame:
    """One nested record per run: configuration, metrics, environment, tags."""
    have = set(apps.columns)

    def group(*names: str) -> Column:
        return F.struct(*[F.col(n) for n in names if n in have])

    return apps.select(
        "app_id",
        "app_name",
        "user_name",
        "status",
        "spark_version",
        "start_time",
        "end_time",
        "duration_ms",
        group("num_executors", "executor_cores", "executor_memory_mb", "driver_memory_mb").alias("configuration"),
        group(
            "total_tasks", "failed_tasks", "total_stages", "failed_stages", "input_bytes", "output_bytes",
            "shuffle_read_bytes", "shuffle_write_bytes", "memory_spilled_bytes", "disk_spilled_bytes",
            "executor_run_time_ms", "executor_cpu_time_ms", "jvm_gc_time_ms", "peak_memory_usage",
        ).alias("metrics"),
        group("cluster_type", "instance_type").alias("environment"),
        "tags",
    )


def display_row(apps: DataFrame) -> DataFrame:
    """What a list of runs shows: short names, minutes, gigabytes, whole-gigabyte memory."""
    return apps.select(
        F.substring("app_id", 1, 20).alias("app_id"),
        F.substring("app_name", 1, 30).alias("name"),
        F.date_format("start_time", "yyyy-MM-dd HH:mm").alias("started"),
        half_even(F.coalesce(F.col("duration_ms"), F.lit(0)) / 60000.0, 1).alias("minutes"),
        half_even(to_gib("input_bytes"), 2).alias("input_gb"),
        F.col("num_executors").cast("long").alias("num_executors"),
        F.col("executor_cores").cast("long").alias("executor_cores"),
        F.concat(F.floor(F.col("executor_memory_mb") / 1024).cast("string"), F.lit("GB")).alias("memory"),
        minutes_seconds(F.col("duration_ms")).alias("took"),
    )


def conf_arguments(config: Column) -> Column:
    """Map of settings -> '--conf k=v --conf ...' in key order."""
    entries = F.array_sort(F.map_entries(config))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(F.lit("--conf "), e["key"], F.lit("="), e["value"])), " "
    )


def submit_command(executors: str, cores: str, executor_mb: str, driver_mb: str) -> Column:
    return F.format_string(
        "spark-submit --num-executors %d --executor-cores %d --executor-memory %dm --driver-memory %dm",
        executors,
        cores,
        executor_mb,
        driver_mb,
    )


def size_class(revenue: Column) -> Column:
    """Below 100 Small, below 500 Medium, else Large."""
    return F.when(revenue < 100, "Small").when(revenue < 500, "Medium").otherwise("Large")
