"""Configurations for new runs: from similar runs, from rules, and from documented formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import collected, half_even, to_gib
from jobsight.operators import neighbors, rules
from jobsight.operators.search import newest, successful
from jobsight.schemas import zero_filled

SETTINGS = ["executor_cores", "executor_memory_mb", "num_executors", "driver_memory_mb"]
MATCH_COLUMNS = ["app_id", *SETTINGS, "spilled", "duration_ms", "run_bytes"]


def history(apps: DataFrame, limit: int | None = None) -> DataFrame:
    """Finished runs with exactly zero failures, nulls zero-filled; all of them, or the newest ``limit``."""
    done = successful(apps, limit=None, strict=True)
    picked = done if limit is None else newest(done, limit=limit)
    return zero_filled(picked)


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def baseline(size: Column, job_type: Column, priority: Column) -> dict[str, Column]:
    """Configuration by input size, job type and priority. All numbers."""
    scale = F.greatest(F.lit(0.5), F.least(F.lit(5.0), to_gib(size) / 10.0))
    executors = F.greatest(F.lit(2).cast("long"), _whole(5 * scale))
    memory = _whole(8192 * F.least(F.lit(2.0), 1.0 + scale / 10.0))
    kind = F.coalesce(job_type, F.lit(""))
    executors = F.when(kind == "streaming", _whole(executors * 1.3)).otherwise(executors)
    memory = F.when(kind == "ml", _whole(memory * 1.5)).when(kind == "streaming", _whole(memory * 0.8)).otherwise(memory)
    driver = F.when(kind == "ml", 6144).otherwise(4096).cast("long")
    fast, cheap = priority == "performance", priority == "cost"
    executors = (
        F.when(fast, _whole(executors * 1.2))
        .when(cheap, F.greatest(F.lit(2).cast("long"), _whole(executors * 0.8)))
        .otherwise(executors)
    )
    memory = F.when(fast, _whole(memory * 1.2)).when(cheap, _whole(memory * 0.8)).otherwise(memory)
    gigabytes = lambda mb: F.greatest(F.lit(2048).cast("long"), (F.rint(mb / 1024.0) * 1024).cast("long"))
    return {
        "executor_cores": F.when(fast, 6).otherwise(4).cast("long"),
        "executor_memory_mb": gigabytes(memory),
        "num_executors": executors,
        "driver_memory_mb": gigabytes(driver),
    }


def rule_based(requests: DataFrame) -> DataFrame:
    """Baseline, then the diagnosis rules on it as if it had run; confidence .7 (fixed value)."""
    base = baseline(F.col("input_bytes"), F.col("job_type"), F.col("priority"))
    planned = requests.withColumns(base).withColumns(
        {
            c: F.lit(0).cast("long")
            for c in (
                "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes", "disk_spilled_bytes",
                "memory_spilled_bytes", "duration_ms", "jvm_gc_time_ms", "total_tasks", "failed_tasks", "total_stages",
            )
        }
    )
    found = planned.withColumn("hints", rules.findings())
    executor, driver = rules.optimized_memory()
    return found.select(
        "request_id",
        "executor_cores",
        executor.alias("executor_memory_mb"),
        "num_executors",
        driver.alias("driver_memory_mb"),
        F.lit(0.7).alias("confidence"),
        F.lit("rule_based").alias("method"),
        F.size("hints").cast("long").alias("rules_applied"),
        F.transform("hints", lambda h: h["rule_id"]).alias("optimization_hints"),
    )


def run_weight(m: Column) -> Column:
    """Weight of a matched run: less for spilling, up to twice for throughput (fixed values)."""
    throughput = F.when(m["duration_ms"] > 0, m["run_bytes"].cast("double") / m["duration_ms"]).otherwise(F.lit(0.0))
    spill = F.when(m["spilled"] > 0, F.lit(0.7)).otherwise(F.lit(1.0))
    return spill * F.when(throughput > 0, F.least(F.lit(2.0), 1.0 + throughput / 1000000.0)).otherwise(F.lit(1.0))


def _in_order_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def weighted_config(matches: Column) -> dict[str, Column]:
    """Weighted mean configuration of an array of matched runs, added in the order of the matches."""
    weights = F.transform(matches, run_weight)
    total = _in_order_sum(weights)

    def mean(field: str) -> Column:
        return _in_order_sum(F.transform(matches, lambda m: m[field] * (run_weight(m) / total)))

    gigabytes = lambda x: F.greatest(F.lit(1024).cast("long"), (F.rint(x / 1024.0) * 1024).cast("long"))
    count = lambda x: F.greatest(F.lit(1).cast("long"), F.rint(x).cast("long"))
    return {
        "executor_cores": count(mean("executor_cores")),
        "executor_memory_mb": gigabytes(mean("executor_memory_mb")),
        "num_executors": count(mean("num_executors")),
        "driver_memory_mb": gigabytes(mean("driver_memory_mb")),
    }


def matches_for(requests: DataFrame, past: DataFrame, k: int = 5, threshold: float = 0.7) -> DataFrame:
    """The most similar past runs per distinct requested size."""
    runs = past.withColumns(
        {"spilled": F.col("disk_spilled_bytes") + F.col("memory_spilled_bytes"), "run_bytes": F.col("input_bytes")}
    )
    return neighbors.nearest_by_size(requests, runs, MATCH_COLUMNS, k, threshold)


def by_similarity(requests: DataFrame, past: DataFrame, k: int = 5, threshold: float = 0.7) -> DataFrame:
    """Weighted mean of the similar runs (confidence .8), or the baseline where there is none (.5); fixed values."""
    found = matches_for(requests, past, k, threshold)
    base = baseline(F.col("input_bytes"), F.col("job_type"), F.col("priority"))
    mean = weighted_config(F.col("matches"))
    hit = F.col("matches").isNotNull()
    joined = requests.join(found, "input_bytes", "left")
    return joined.select(
        "request_id",
        *[F.when(hit, mean[c]).otherwise(base[c]).alias(c) for c in SETTINGS],
        F.when(hit, 0.8).otherwise(0.5).alias("confidence"),
        F.when(hit, "similarity").otherwise("fallback").alias("method"),
        F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("similar_jobs_count"),
        F.transform("matches", lambda m: m["app_id"]).alias("similar_jobs"),
    )


def fallback(requests: DataFrame) -> DataFrame:
    base = baseline(F.col("input_bytes"), F.col("job_type"), F.col("priority"))
    return requests.select(
        "request_id",
        *[v.alias(k) for k, v in base.items()],
        F.lit(0.5).alias("confidence"),
        half_even(to_gib("input_bytes"), 2).alias("input_gb"),
    )


def compare_methods(*answers: DataFrame) -> DataFrame:
    """Answers of several methods side by side, one row per request."""
    slim = [a.select("request_id", "method", *SETTINGS) for a in answers]
    both = slim[0]
    for s in slim[1:]:
        both = both.unionByName(s)
    return both


def executor_hour_cost(executors: Column, memory_mb: Column, hours: Column) -> Column:
    """Rough cost: 0.10 per executor hour and 4 GB of memory (fixed values)."""
    return executors * hours * (0.10 * (memory_mb / 1024.0 / 4.0))


# Documented formulas -------------------------------------------------------------

# Size category by upper bound in GB -> executors, cores, memory
SIZE_CATEGORIES = [("small", 10.0, 5, 2, 4096), ("medium", 100.0, 10, 4, 8192), ("large", 1000.0, 20, 4, 16384)]
LARGEST_CATEGORY = ("xlarge", 50, 4, 16384)
# Job type -> memory and executor multipliers
TYPE_MULTIPLIERS = {"etl": (1.0, 1.0), "ml": (1.5, 0.8), "sql": (1.2, 1.0), "streaming": (1.3, 1.2)}


def by_category(requests: DataFrame) -> DataFrame:
    """Configuration by size category and job-type multipliers."""
    gb = to_gib("input_bytes")

    def pick(at: int) -> Column:
        name, *rest = LARGEST_CATEGORY
        out = F.lit([name, *rest][at])
        for category, bound, *values in reversed(SIZE_CATEGORIES):
            out = F.when(gb <= bound, F.lit([category, *values][at])).otherwise(out)
        return out

    kind = F.coalesce("job_type", F.lit(""))
    memory_factor, executor_factor = F.lit(1.0), F.lit(1.0)
    for job_type, (m, e) in TYPE_MULTIPLIERS.items():
        memory_factor = F.when(kind == job_type, F.lit(m)).otherwise(memory_factor)
        executor_factor = F.when(kind == job_type, F.lit(e)).otherwise(executor_factor)
    return requests.select(
        "request_id",
        pick(0).alias("category"),
        F.greatest(F.lit(1).cast("long"), _whole(pick(1) * executor_factor)).alias("num_executors"),
        pick(2).cast("long").alias("executor_cores"),
        _whole(pick(3) * memory_factor).alias("executor_memory_mb"),
    )


def hybrid(answers: DataFrame) -> DataFrame:
    """Confidence-weighted mean of the methods per request.

    Similar runs count from a confidence above .7, learned answers above .8, rules always with .5 (fixed values).
    """
    weight = (
        F.when((F.col("method") == "similarity") & (F.col("confidence") > 0.7), F.col("confidence"))
        .when((F.col("method") == "ml") & (F.col("confidence") > 0.8), F.col("confidence"))
        .when(F.col("method") == "rule_based", F.lit(0.5))
    )
    usable = answers.withColumn("_w", weight).filter(F.col("_w").isNotNull())
    # weights carry at most two places, so hundredths keep the sums exact
    w = F.rint(F.col("_w") * 100).cast("long")
    return usable.groupBy("request_id").agg(
        *[
            F.rint(F.sum(F.col(c) * w).cast("double") / F.sum(w)).cast("long").alias(c)
            for c in SETTINGS
        ],
        F.count(F.lit(1)).alias("methods"),
    )


def documented_confidence(history_size: Column, best_similarity: Column, extrapolates: Column) -> Column:
    """Confidence by history, similarity and range. Limits and factors."""
    return (
        F.when(history_size < 10, 0.6).otherwise(1.0)
        * F.when(best_similarity < 0.7, 0.7).otherwise(1.0)
        * F.when(extrapolates, 0.8).otherwise(1.0)
    )


def executors_within(budget: Column, unit_cost: Column, executors: Column) -> Column:
    """Executors left after taking one away until the cost fits or fewer than two remain."""
    fitting = F.floor(budget / unit_cost).cast("long")
    return F.when(executors * unit_cost <= budget, executors).otherwise(
        F.greatest(F.least(fitting, executors - 1), F.least(executors - 1, F.lit(1).cast("long")))
    )


def config_errors(max_cluster_cores: int) -> Column:
    """Array of failed checks of a configuration. Limits and texts."""
    total = F.col("num_executors") * F.col("executor_cores")
    return collected(
        (F.col("num_executors") < 1, F.lit("Must have at least 1 executor")),
        (F.col("executor_memory_mb") < 1024, F.lit("Executor memory must be at least 1GB")),
        (
            F.col("executor_memory_mb") / F.col("executor_cores") < 1024,
            F.lit("Memory per core should be at least 1GB"),
        ),
        (
            total > max_cluster_cores,
            F.format_string("Total cores (%d) exceeds cluster capacity", total.cast("long")),
        ),
    )
