"""Features of a run, their statistics and their normalised forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import to_gib

FEATURES = [
    "input_size_gb", "output_size_gb", "shuffle_size_gb", "total_cores", "total_memory_gb", "executor_cores_feature",
    "num_stages", "num_tasks", "avg_tasks_per_stage", "io_ratio", "shuffle_to_input_ratio",
]


def finite(x: Column) -> Column:
    """NaN and infinities become zero."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def run_features() -> dict[str, Column]:
    """The eleven features of a run, in the order of FEATURES."""
    d = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    at_least_one = lambda c: F.greatest(d(c), F.lit(1.0))
    values = [
        to_gib(d("input_bytes")),
        to_gib(d("output_bytes")),
        to_gib(d("shuffle_read_bytes")),
        d("num_executors") * d("executor_cores"),
        d("num_executors") * d("executor_memory_mb") / 1024.0,
        d("executor_cores"),
        d("total_stages"),
        d("total_tasks"),
        d("total_tasks") / at_least_one("total_stages"),
        d("output_bytes") / at_least_one("input_bytes"),
        d("shuffle_read_bytes") / at_least_one("input_bytes"),
    ]
    return {name: finite(v) for name, v in zip(FEATURES, values)}


def with_features(jobs: DataFrame, key: str = "app_id") -> DataFrame:
    return jobs.select(key, *[v.alias(k) for k, v in run_features().items()])


def fit(matrix: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of statistics per feature: mean, population deviation, minimum, maximum; a zero spread counts as one."""
    names = columns or FEATURES
    one_row = matrix.agg(
        *[
            F.struct(
                F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
            ).alias(c)
            for c in names
        ]
    )
    return one_row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"{c}.mean").alias("mean"),
                        F.when(F.col(f"{c}.max") == F.col(f"{c}.min"), 1.0).otherwise(F.col(f"{c}.std")).alias("std"),
                        F.col(f"{c}.min").alias("min"),
                        F.when(F.col(f"{c}.max") == F.col(f"{c}.min"), F.col(f"{c}.min") + 1.0)
                        .otherwise(F.col(f"{c}.max"))
                        .alias("max"),
                    )
                    for c in names
                ]
            )
        )
    )


def transform(matrix: DataFrame, stats: DataFrame, method: str = "standard", columns: list[str] | None = None) -> DataFrame:
    """Normalise by fitted statistics, one row per feature: 'standard' or 'minmax'.

    For 'log' fit and transform the output of ``log_scaled``. The statistics are a subquery of the plan, so nothing runs
    before the result is asked for.
    """
    names = columns or FEATURES
    entry = F.struct("feature", F.struct("mean", "std", "min", "max"))
    by_name = stats.agg(F.map_from_entries(F.collect_list(entry)).alias("_stats")).scalar()
    s = lambda c, statistic: F.col("_stats")[c][statistic]
    if method in ("standard", "log"):
        value = lambda c: (F.col(c) - s(c, "mean")) / s(c, "std")
    elif method == "minmax":
        value = lambda c: (F.col(c) - s(c, "min")) / (s(c, "max") - s(c, "min"))
    else:
        raise ValueError(f"unknown normalisation method {method}")
    return matrix.withColumn("_stats", by_name).withColumns({c: finite(value(c)) for c in names}).drop("_stats")


def log_scaled(matrix: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return matrix.withColumns({c: F.log1p(F.abs(F.col(c))) for c in columns or FEATURES})


def fit_transform(matrix: DataFrame, method: str = "standard") -> DataFrame:
    base = log_scaled(matrix) if method == "log" else matrix
    return transform(base, fit(base), method)
