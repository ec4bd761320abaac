"""Canonical tables of the job store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "STRINGS": T.ArrayType(T.StringType()),
    "STRING_MAP": T.MapType(T.StringType(), T.StringType()),
}


def schema(text: str) -> T.StructType:
    """'name TYPE, name TYPE' -> StructType, without the need of a running session."""
    pairs = (item.split() for item in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


APPLICATIONS = schema(
    """app_id STRING, app_name STRING, user_name STRING,
    submit_time TIMESTAMP, start_time TIMESTAMP, end_time TIMESTAMP, duration_ms BIGINT,
    status STRING, spark_version STRING,
    executor_cores INT, executor_memory_mb INT, num_executors INT, driver_memory_mb INT,
    total_tasks BIGINT, failed_tasks BIGINT, total_stages BIGINT, failed_stages BIGINT,
    input_bytes BIGINT, output_bytes BIGINT, shuffle_read_bytes BIGINT, shuffle_write_bytes BIGINT,
    memory_spilled_bytes BIGINT, disk_spilled_bytes BIGINT,
    executor_run_time_ms BIGINT, executor_cpu_time_ms BIGINT, jvm_gc_time_ms BIGINT, peak_memory_usage BIGINT,
    cluster_type STRING, instance_type STRING, estimated_cost DOUBLE,
    tags STRING_MAP, environment STRING_MAP, spark_configs STRING_MAP"""
)

STAGES = schema(
    """app_id STRING, stage_id INT, stage_name STRING, num_tasks BIGINT, duration_ms BIGINT,
    executor_run_time_ms BIGINT, executor_cpu_time_ms BIGINT,
    memory_spilled_bytes BIGINT, disk_spilled_bytes BIGINT,
    input_bytes BIGINT, output_bytes BIGINT, shuffle_read_bytes BIGINT, shuffle_write_bytes BIGINT"""
)

RECOMMENDATIONS = schema(
    """recommendation_id BIGINT, job_signature STRING,
    recommended_executor_cores INT, recommended_executor_memory_mb INT,
    recommended_num_executors INT, recommended_driver_memory_mb INT,
    predicted_duration_ms BIGINT, predicted_cost DOUBLE, confidence_score DOUBLE,
    recommendation_method STRING, similar_jobs STRINGS,
    created_at TIMESTAMP, used_at TIMESTAMP, feedback_score DOUBLE"""
)

METRIC_POINTS = schema(
    "event_id BIGINT, app_id STRING, ts TIMESTAMP, metric_name STRING, value DOUBLE"
)

# Columns that analysis reads as zero when the store holds null.
ZERO_FILLED = [
    "duration_ms", "executor_cores", "executor_memory_mb", "num_executors", "driver_memory_mb",
    "total_tasks", "failed_tasks", "total_stages", "failed_stages",
    "input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
    "memory_spilled_bytes", "disk_spilled_bytes",
    "executor_run_time_ms", "executor_cpu_time_ms", "jvm_gc_time_ms", "peak_memory_usage",
]

# Names used by the log readers -> names of the store.
RENAMES = {
    "user": "user_name",
    "spill_disk_bytes": "disk_spilled_bytes",
    "spill_memory_bytes": "memory_spilled_bytes",
    "executor_run_time": "executor_run_time_ms",
    "executor_cpu_time": "executor_cpu_time_ms",
    "jvm_gc_time": "jvm_gc_time_ms",
}


def zero_filled(apps: DataFrame) -> DataFrame:
    """The table analysis works on: every metric null becomes zero."""
    return apps.na.fill(0, [c for c in ZERO_FILLED if c in apps.columns])


def conform(df: DataFrame, schema: T.StructType, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename, order and cast to a canonical schema; absent columns become typed nulls."""
    names = renames or {}
    back = {new: old for old, new in names.items() if old in df.columns and new not in df.columns}
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        source = back.get(f.name, f.name)
        value = F.col(source) if source in have else F.lit(None)
        cols.append(value.cast(f.dataType).alias(f.name))
    return df.select(*cols)
