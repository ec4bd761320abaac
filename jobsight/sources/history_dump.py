"""Dumps of the history service, landed as JSON: application list, details, executors and environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.units import epoch_or_iso, memory_mb

# Field names of the payloads
APP_SCHEMA = """
id STRING, name STRING, attempts ARRAY<STRUCT<attemptId: STRING, sparkUser: STRING, startTimeEpoch: BIGINT,
  endTimeEpoch: BIGINT, startTime: STRING, endTime: STRING, duration: BIGINT, completed: BOOLEAN>>"""
DETAILS_SCHEMA = "id STRING, totalTasks BIGINT, failedTasks BIGINT, totalStages BIGINT"
EXECUTORS_SCHEMA = """
id STRING, executors ARRAY<STRUCT<id: STRING, totalInputBytes: BIGINT, totalShuffleRead: BIGINT,
  totalShuffleWrite: BIGINT, totalDiskBytesSpilled: BIGINT, totalMemoryBytesSpilled: BIGINT, totalDuration: BIGINT>>"""
ENVIRONMENT_SCHEMA = "id STRING, sparkProperties ARRAY<ARRAY<STRING>>"


def parse(landed: DataFrame, schema: str) -> DataFrame:
    """Landed text rows (value) -> columns; a row that is no JSON or has no id is dropped."""
    return landed.select(F.from_json("value", schema).alias("d")).select("d.*").filter(F.col("id").isNotNull())


def last_attempt() -> Column:
    return F.try_element_at(F.col("attempts"), F.lit(-1))


def ended(attempt: Column) -> Column:
    return attempt["endTime"].isNotNull() | attempt["endTimeEpoch"].isNotNull()


def select_applications(
    apps: DataFrame, status: str | None = None, min_start_ms: int | None = None, limit: int | None = None
) -> DataFrame:
    """Applications whose last attempt is completed or running, started late enough, newest first if limited."""
    out = apps
    latest = last_attempt()
    if status in ("completed", "running"):
        done = ended(latest)
        out = out.filter(latest.isNotNull() & (done if status == "completed" else ~done))
    if min_start_ms is not None:
        out = out.filter(latest["startTimeEpoch"] >= min_start_ms)
    if limit is not None:
        out = out.orderBy(latest["startTimeEpoch"].desc_nulls_last(), "id").limit(limit)
    return out


def normalise(apps: DataFrame, details: DataFrame, executors: DataFrame, environment: DataFrame) -> DataFrame:
    """Application rows. The executors of one application are summed inside its row, the driver left out."""
    joined = apps.join(details, "id", "left").join(executors, "id", "left").join(environment, "id", "left")
    workers = F.filter(F.coalesce("executors", F.array().cast(executors.schema["executors"].dataType)), lambda e: e["id"] != "driver")

    def total(field: str) -> Column:
        return F.aggregate(workers, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e[field], F.lit(0)))

    conf = F.map_from_entries(
        F.transform(
            F.coalesce("sparkProperties", F.array().cast("array<array<string>>")),
            lambda p: F.struct(p[0].alias("key"), p[1].alias("value")),
        )
    )
    latest = last_attempt()

    def memory(name: str) -> Column:
        return memory_mb(F.coalesce(conf[name], F.lit("1g")), bare_unit="bytes", empty_mb=1024)

    # Absent settings count as 1g and one core
    return joined.select(
        F.col("id").alias("app_id"),
        F.col("name").alias("app_name"),
        F.coalesce(latest["sparkUser"], F.lit("unknown")).alias("user_name"),
        epoch_or_iso(latest["startTimeEpoch"], latest["startTime"]).alias("start_time"),
        epoch_or_iso(latest["endTimeEpoch"], latest["endTime"]).alias("end_time"),
        latest["duration"].alias("duration_ms"),
        F.size(workers).alias("num_executors"),
        F.coalesce(conf["spark.executor.cores"].try_cast("int"), F.lit(1)).alias("executor_cores"),
        memory("spark.executor.memory").cast("int").alias("executor_memory_mb"),
        memory("spark.driver.memory").cast("int").alias("driver_memory_mb"),
        F.coalesce("totalTasks", F.lit(0)).alias("total_tasks"),
        F.coalesce("failedTasks", F.lit(0)).alias("failed_tasks"),
        F.coalesce("totalStages", F.lit(0)).alias("total_stages"),
        total("totalInputBytes").alias("input_bytes"),
        F.lit(0).cast("long").alias("output_bytes"),
        total("totalShuffleRead").alias("shuffle_read_bytes"),
        total("totalShuffleWrite").alias("shuffle_write_bytes"),
        total("totalDiskBytesSpilled").alias("disk_spilled_bytes"),
        total("totalMemoryBytesSpilled").alias("memory_spilled_bytes"),
        total("totalDuration").alias("executor_run_time_ms"),
    )
