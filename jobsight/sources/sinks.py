"""Writing the job store: insert-if-absent, upserts, deletes, catalogs and patterns.

The store is Parquet partitioned by start date. Plain Parquet has no row
updates, so an update or delete writes the new version of the table to a new
folder and returns its path; the caller switches readers to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight import schemas
from jobsight.functions.units import memory_mb
from jobsight.sources.event_log import flat_or_nested


def classify_new(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows with ``outcome``: collected, skipped (known or repeated id) or failed (no id).

    Repeats are settled by an aggregate over the id, so one id with very many copies costs one row per task.
    """
    with_id = incoming.filter(F.col("app_id").isNotNull())
    order = F.struct(*[F.col(c) for c in _orderable(with_id)])
    unique = with_id.groupBy("app_id").agg(
        F.min_by(F.struct(*incoming.columns), order).alias("_row"), F.count(F.lit(1)).alias("_copies")
    )
    known = existing.select("app_id", F.lit(True).alias("_known")).distinct()
    judged = unique.join(known, "app_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    return judged.select(
        "_row.*",
        F.when(F.col("_known"), "skipped").otherwise("collected").alias("outcome"),
        "_copies",
    )


def _orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]


def insert_counts(incoming: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per outcome; extra copies of an id count as skipped, rows without id as failed."""
    per_row = judged.select(
        F.explode(
            F.array(
                F.struct("outcome", F.lit(1).cast("long").alias("n")),
                F.struct(F.lit("skipped").alias("outcome"), (F.col("_copies") - 1).alias("n")),
            )
        ).alias("o")
    ).select("o.*")
    lost = incoming.filter(F.col("app_id").isNull()).agg(F.lit("failed").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return per_row.unionByName(lost).groupBy("outcome").agg(F.sum("n").alias("rows")).filter(F.col("rows") > 0)


def new_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return classify_new(incoming, existing).filter(F.col("outcome") == "collected").drop("outcome", "_copies")


def canonical_jobs(records: DataFrame) -> DataFrame:
    """Job records of any reader as store rows: nested or flat numbers, memory as text or MB."""
    out = flat_or_nested(records)
    for mb, text in (("executor_memory_mb", "executor_memory"), ("driver_memory_mb", "driver_memory")):
        given = [F.col(f"configuration.{mb}").cast("string")] if _nested(records, "configuration", mb) else []
        if mb in records.columns:
            given.append(F.col(mb).cast("string"))
        if text in records.columns:
            given.append(F.col(text))
        out = out.withColumn(mb, memory_mb(F.coalesce(*given, F.lit("0"))).cast("int"))
    return schemas.conform(out, schemas.APPLICATIONS, schemas.RENAMES)


def _nested(df: DataFrame, group: str, name: str) -> bool:
    return group in df.columns and name in df.schema[group].dataType.fieldNames()


def write_applications(apps: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per start month. Rebalancing gives a quiet month one file and splits a busy one into several."""
    (
        schemas.conform(apps, schemas.APPLICATIONS, schemas.RENAMES)
        .withColumn("start_month", F.date_format("start_time", "yyyy-MM"))
        .hint("rebalance", "start_month")
        .write.mode(mode)
        .partitionBy("start_month")
        .parquet(path)
    )


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def holds_data(spark: SparkSession, path: str) -> bool:
    """Whether the store's folder is there, in whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def ingest(incoming: DataFrame, spark: SparkSession, path: str) -> None:
    """Append what the store does not hold yet; a second run of the same input appends nothing.

    What is known is read from the store itself, so a replayed first batch finds what its first run wrote, and a first
    batch that failed before it committed anything finds an empty store.
    """
    if holds_data(spark, path):
        known = spark.read.schema("app_id STRING").parquet(path)
    else:
        known = spark.createDataFrame([], "app_id STRING")
    write_applications(new_rows(incoming, known), path)


def write_recommendations(recs: DataFrame, path: str) -> None:
    schemas.conform(recs, schemas.RECOMMENDATIONS).write.mode("append").parquet(path)


def write_stages(stages: DataFrame, path: str) -> None:
    schemas.conform(stages, schemas.STAGES).write.mode("append").parquet(path)


CLEARED = "cleared_fields"


def updated(table: DataFrame, updates: DataFrame, key: str, now: Column, order: str | None = None) -> DataFrame:
    """New version of a table: fields given for a key replace the old ones, unknown keys and fields are ignored.

    A null field is not given; to set fields to null, name them in an array column ``cleared_fields``. Several updates
    of a key are folded first: of each field the last given value by ``order`` wins, or the largest without an order.
    """
    fields = [c for c in updates.columns if c in table.columns and c not in (key, order)]
    at = F.col(order) if order else F.lit(0)
    cleared = F.col(CLEARED) if CLEARED in updates.columns else F.array().cast("array<string>")
    folded = {}
    for c in fields:
        is_cleared = F.coalesce(F.array_contains(cleared, c), F.lit(False))
        # The value travels in a struct, so that a cleared field is given and null.
        given = F.when(is_cleared | F.col(c).isNotNull(), F.struct(F.when(~is_cleared, F.col(c)).alias("v")))
        folded[c] = F.max_by(given, F.when(given.isNotNull(), F.struct(at, given)))
    u = updates.groupBy(key).agg(*[v.alias(f"_new_{c}") for c, v in folded.items()], F.lit(True).alias("_hit"))
    joined = table.join(u, key, "left")
    cols = [
        F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in table.columns
    ]
    return joined.select(*cols, F.when(F.col("_hit"), now).alias("updated_at"))


def write_version(table: DataFrame, store: str) -> str:
    """Write a new version of a table beside the older ones and return its folder."""
    path = f"{store.rstrip('/')}/version-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """New version of a table (or of one that hangs on it) without the given keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; a line that is no JSON is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
