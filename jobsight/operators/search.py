"""Finding runs, recommendations, feedback and sessions in the store.

Each search folds the given criteria into one predicate, so the filters reach
the Parquet scan, and ends in a top-k with a unique tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criteria:
    """What a run must look like; anything left out does not restrict."""

    name_contains: str | None = None
    input_range: tuple[int | None, int | None] | None = None
    input_near: int | None = None
    input_tolerance: float = 0.5
    executor_range: tuple[int | None, int | None] | None = None
    duration_range: tuple[int | None, int | None] | None = None
    status: str | None = None
    successful_only: bool = False
    min_success_rate: float | None = None
    started_from: str | None = None
    started_to: str | None = None
    cluster_type: str | None = None
    spark_version: str | None = None
    job_type: str | None = None

    def predicates(self) -> list[Column]:
        out: list[Column] = []
        if self.name_contains is not None:
            out.append(F.col("app_name").ilike(f"%{self.name_contains}%"))
        out += within("input_bytes", self.input_range)
        if self.input_near is not None:
            low = int(self.input_near * (1 - self.input_tolerance))
            high = int(self.input_near * (1 + self.input_tolerance))
            out += within("input_bytes", (low, high))
        out += within("num_executors", self.executor_range)
        out += within("duration_ms", self.duration_range)
        if self.status is not None:
            out.append(F.col("status") == self.status)
        if self.successful_only:
            out.append(no_failures())
        if self.min_success_rate is not None:
            out.append(success_rate_at_least(self.min_success_rate))
        if self.started_from is not None:
            out.append(F.col("start_time") >= F.lit(self.started_from).cast("timestamp"))
        if self.started_to is not None:
            out.append(F.col("start_time") <= F.lit(self.started_to).cast("timestamp"))
        if self.cluster_type is not None:
            out.append(F.col("cluster_type") == self.cluster_type)
        if self.spark_version is not None:
            out.append(F.col("spark_version").ilike(f"{self.spark_version}%"))
        if self.job_type is not None:
            out.append(F.col("tags")["job_type"] == self.job_type)
        return out


def within(column: str, bounds: tuple[int | None, int | None] | None) -> list[Column]:
    """Predicates of a range that may be open on either side."""
    if bounds is None:
        return []
    low, high = bounds
    out = []
    if low is not None:
        out.append(F.col(column) >= low)
    if high is not None:
        out.append(F.col(column) <= high)
    return out


def no_failures() -> Column:
    """A run that reported no failure yet counts as successful."""
    return F.coalesce(F.col("failed_tasks"), F.lit(0)) == 0


def known_zero_failures() -> Column:
    """The stricter reading: the run reported exactly zero failures."""
    return F.col("failed_tasks") == 0


def success_rate_at_least(rate: float) -> Column:
    done = F.col("total_tasks") - F.coalesce(F.col("failed_tasks"), F.lit(0))
    return (F.col("total_tasks") > 0) & (done >= F.col("total_tasks") * F.lit(rate))


def where_all(df: DataFrame, predicates: Sequence[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, predicates)) if predicates else df


def matching(apps: DataFrame, criteria: Criteria) -> DataFrame:
    """Runs that meet the criteria. On the stored table a date range also leaves out the months outside it."""
    wanted = criteria.predicates()
    if "start_month" in apps.columns:
        if criteria.started_from is not None:
            wanted.append(F.col("start_month") >= criteria.started_from[:7])
        if criteria.started_to is not None:
            wanted.append(F.col("start_month") <= criteria.started_to[:7])
    return where_all(apps, wanted)


def newest(df: DataFrame, by: str = "end_time", key: str = "app_id", limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(by).desc_nulls_last(), key)
    return out if limit is None else out.limit(limit)


def search(apps: DataFrame, criteria: Criteria, limit: int = 10, order_by: str = "end_time") -> DataFrame:
    """Composite search; ``order_by='input_size'`` puts the closest input first."""
    found = matching(apps, criteria)
    if order_by == "input_size" and criteria.input_near is not None:
        return found.orderBy(F.abs(F.col("input_bytes") - criteria.input_near), "app_id").limit(limit)
    return newest(found, limit=limit)


def recent(apps: DataFrame, now: str, days: int = 30, limit: int = 100) -> DataFrame:
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return newest(apps.filter(F.col("submit_time") >= cutoff), by="submit_time", limit=limit)


def by_input_range(apps: DataFrame, low: int, high: int, limit: int = 50) -> DataFrame:
    return newest(where_all(apps, [*within("input_bytes", (low, high)), known_zero_failures()]), limit=limit)


def successful(apps: DataFrame, limit: int | None = 100, strict: bool = False) -> DataFrame:
    """Finished runs without failures, newest first."""
    clean = known_zero_failures() if strict else no_failures()
    done = apps.filter(clean & F.col("duration_ms").isNotNull() & F.col("end_time").isNotNull())
    return newest(done, limit=limit) if limit is not None else done


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def page(
    apps: DataFrame,
    criteria: Criteria,
    offset: int = 0,
    limit: int = 50,
    min_seconds: int | None = None,
    max_seconds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page of runs by start time, one row with the total before paging)."""
    bounds = within(
        "duration_ms",
        (None if min_seconds is None else min_seconds * 1000, None if max_seconds is None else max_seconds * 1000),
    )
    found = where_all(apps, [*criteria.predicates(), *bounds])
    rows = found.orderBy(F.col("start_time").desc_nulls_last(), "app_id").offset(offset).limit(limit)
    return rows, found.agg(F.count(F.lit(1)).alias("total"))


def closest_size(apps: DataFrame, target: int, limit: int) -> DataFrame:
    return apps.orderBy(F.abs(F.col("input_bytes") - target), "app_id").limit(limit)


def recent_recommendations(recs: DataFrame, limit: int = 50, with_feedback: bool = False) -> DataFrame:
    rows = recs.filter(F.col("feedback_percent").isNotNull()) if with_feedback else recs
    return rows.orderBy(F.desc("created_ms"), "recommendation_id").limit(limit)


def recent_feedback(
    feedback: DataFrame,
    session_id: int | None = None,
    app_key: int | None = None,
    since_ms: int | None = None,
    limit: int = 100,
) -> DataFrame:
    wanted = []
    if session_id is not None:
        wanted.append(F.col("session_id") == session_id)
    if app_key is not None:
        wanted.append(F.col("app_key") == app_key)
    if since_ms is not None:
        wanted.append(F.col("ts_ms") > since_ms)
    return where_all(feedback, wanted).orderBy(F.desc("ts_ms"), "session_id", "part_key", "app_key").limit(limit)


def trainable(apps: DataFrame) -> DataFrame:
    """Runs a learner can use: all four targets and the input size are known and positive."""
    fields = ["executor_cores", "executor_memory_mb", "num_executors", "driver_memory_mb", "input_bytes"]
    return where_all(apps, [F.col(c) > 0 for c in fields])


def latest_per_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest row of every key, by an aggregate that combines before the shuffle."""
    newest_row = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(newest_row).select(key, "_row.*")


def found_and_missing(requested: DataFrame, apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested ids that exist, with their runs, and the ids that do not."""
    return apps.join(requested, "app_id", "left_semi"), requested.join(apps, "app_id", "left_anti")
