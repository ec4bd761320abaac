"""Tuning sessions, configuration checks and configuration change logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobsight.functions.numeric import clamp, collected, half_even
from jobsight.operators.ordered import with_running
from jobsight.session import stored

# Parameter -> current, min, max, step, unit
TUNABLE = {
    "spark.executor.memory": (4096.0, 1024.0, 32768.0, 1024.0, "MB"),
    "spark.executor.cores": (4.0, 1.0, 16.0, 1.0, "cores"),
    "spark.executor.instances": (5.0, 1.0, 100.0, 1.0, "executors"),
    "spark.driver.memory": (2048.0, 512.0, 16384.0, 512.0, "MB"),
    "spark.sql.shuffle.partitions": (200.0, 10.0, 2000.0, 50.0, "partitions"),
    "spark.default.parallelism": (100.0, 10.0, 1000.0, 10.0, "tasks"),
    "spark.memory.fraction": (0.6, 0.3, 0.9, 0.05, "fraction"),
    "spark.memory.storageFraction": (0.5, 0.2, 0.8, 0.05, "fraction"),
}
# Step multiplier of a strategy; metrics that are better when lower
STRATEGIES = {"conservative": 0.5, "moderate": 1.0, "aggressive": 2.0}
LOWER_IS_BETTER = ["duration", "cost", "gc_time", "spill_bytes", "latency"]
MAX_ITERATIONS, CONVERGENCE = 20, 0.02

# Parameter -> type, min, max, default
CONSTRAINTS = {
    "spark.executor.memory": ("memory", 512.0, 65536.0, 4096.0),
    "spark.executor.cores": ("integer", 1.0, 32.0, 4.0),
    "spark.executor.instances": ("integer", 1.0, 500.0, 2.0),
    "spark.driver.memory": ("memory", 512.0, 32768.0, 2048.0),
    "spark.driver.cores": ("integer", 1.0, 16.0, 1.0),
    "spark.sql.shuffle.partitions": ("integer", 1.0, 10000.0, 200.0),
    "spark.default.parallelism": ("integer", 1.0, 10000.0, 100.0),
    "spark.memory.fraction": ("float", 0.1, 0.95, 0.6),
    "spark.memory.storageFraction": ("float", 0.1, 0.9, 0.5),
    "spark.shuffle.compress": ("boolean", None, None, 1.0),
    "spark.shuffle.spill.compress": ("boolean", None, None, 1.0),
    "spark.dynamicAllocation.enabled": ("boolean", None, None, 0.0),
    "spark.dynamicAllocation.minExecutors": ("integer", 0.0, 100.0, 0.0),
    "spark.dynamicAllocation.maxExecutors": ("integer", 1.0, 500.0, 10.0),
}
# Parameters to look at together
RELATED = {
    "spark.executor.memory": ["spark.memory.fraction", "spark.executor.memoryOverhead"],
    "spark.executor.cores": ["spark.task.cpus", "spark.default.parallelism"],
    "spark.executor.instances": ["spark.dynamicAllocation.minExecutors", "spark.dynamicAllocation.maxExecutors"],
}

# Column of a session table -> parameter it stands for
SESSION_CONFIG = {
    "executor_memory": "spark.executor.memory",
    "memory_fraction": "spark.memory.fraction",
    "parallelism": "spark.default.parallelism",
    "shuffle_partitions": "spark.sql.shuffle.partitions",
    "executor_cores": "spark.executor.cores",
    "executor_instances": "spark.executor.instances",
}
# Metrics a step looks at, with the value a missing one counts as
STEP_METRICS = {
    "memory_spill_ratio": 0.0,
    "disk_spill_bytes": 0.0,
    "gc_time_percent": 0.0,
    "cpu_utilization": 100.0,
    "shuffle_spill_ratio": 0.0,
    "task_failure_rate": 0.0,
    "task_throughput": 0.0,
}


def lower_is_better(metric: Column) -> Column:
    name = F.lower(metric)
    out = F.lit(False)
    for m in LOWER_IS_BETTER:
        out = out | name.contains(m)
    return out


def parameters(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """Tunable parameters; an override row (parameter, min_value, max_value, step_size) replaces what it gives."""
    base = spark.createDataFrame(
        [(k, *v) for k, v in TUNABLE.items()],
        "parameter string, current_value double, min_value double, max_value double, step_size double, unit string",
    )
    if overrides is None:
        return base
    fields = ["min_value", "max_value", "step_size"]
    o = overrides.select("parameter", *[F.col(f).alias(f"_{f}") for f in fields])
    return base.join(o, "parameter", "left").select(
        "parameter", "current_value", *[F.coalesce(f"_{f}", f).alias(f) for f in fields], "unit"
    )


def _steps(cfg: Column, m: Column, strategy: Column, on_cost: Column, ranges: dict) -> dict[str, tuple[Column, Column, Column]]:
    """Column -> (condition, new value, reason) of the adjustments for one set of metrics."""
    factor = F.lit(1.0)
    for name, value in STRATEGIES.items():
        factor = F.when(strategy == name, F.lit(value)).otherwise(factor)

    def metric(name: str) -> Column:
        return F.coalesce(m[name], F.lit(STEP_METRICS[name]))

    def bounds(column: str) -> tuple[float, float, float]:
        _, low, high, step, _ = ranges[SESSION_CONFIG[column]]
        return low, high, step

    def up(column: str) -> Column:
        _, high, step = bounds(column)
        return F.least(cfg[column] + F.floor(F.lit(step) * factor).cast("double"), F.lit(high))

    def down(column: str, by: Column) -> Column:
        return F.greatest(cfg[column] - by, F.lit(bounds(column)[0]))

    spill, failures = metric("memory_spill_ratio"), metric("task_failure_rate")
    # Limits of the metrics and texts
    return {
        "executor_memory": (
            (spill > 0.1) | (metric("disk_spill_bytes") > 0),
            up("executor_memory"),
            F.format_string("Memory spilling detected (ratio: %.2f)", spill),
        ),
        "memory_fraction": (
            metric("gc_time_percent") > 10,
            half_even(down("memory_fraction", F.lit(bounds("memory_fraction")[2]) * factor), 2),
            F.format_string("High GC time (%.1f%%)", metric("gc_time_percent")),
        ),
        "parallelism": (
            metric("cpu_utilization") < 50,
            up("parallelism"),
            F.format_string("Low CPU utilization (%.1f%%)", metric("cpu_utilization")),
        ),
        "shuffle_partitions": (
            metric("shuffle_spill_ratio") > 0.2,
            up("shuffle_partitions"),
            F.format_string("High shuffle spill ratio (%.2f)", metric("shuffle_spill_ratio")),
        ),
        "executor_cores": (
            failures > 0.05,
            down("executor_cores", F.floor(F.lit(bounds("executor_cores")[2]) * factor).cast("double")),
            F.format_string("High task failure rate (%.1f%%)", failures * 100),
        ),
        "executor_instances": (
            on_cost & (metric("task_throughput") > 0) & (failures < 0.01),
            down("executor_instances", F.lit(1.0)),
            F.lit("Cost optimization - reducing executors"),
        ),
    }


def adjustments(cfg: Column, m: Column, strategy: Column, target_metric: Column, ranges: dict = TUNABLE) -> Column:
    """Array of struct(parameter, old_value, new_value, reason) advised for a configuration and its metrics."""
    on_cost = target_metric == "cost"
    items = []
    for column, (when, new, reason) in _steps(cfg, m, strategy, on_cost, ranges).items():
        items.append(
            (
                when & (new != cfg[column]),
                F.struct(
                    F.lit(SESSION_CONFIG[column]).alias("parameter"),
                    cfg[column].alias("old_value"),
                    new.alias("new_value"),
                    reason.alias("reason"),
                ),
            )
        )
    return collected(*items)


def first_iterations(iterations: DataFrame, order: Sequence[str], limit: int = MAX_ITERATIONS) -> DataFrame:
    """The rows a session can still look at: it ends after ``limit`` iterations that have the target metric."""
    place = W.partitionBy("session").orderBy(*order)
    usable = iterations.filter(F.col("target").isNotNull())
    return usable.withColumn("iteration", F.row_number().over(place)).filter(F.col("iteration") <= limit)


def run_sessions(
    iterations: DataFrame,
    order: Sequence[str],
    max_iterations: int = MAX_ITERATIONS,
    convergence: float = CONVERGENCE,
    ranges: dict = TUNABLE,
) -> DataFrame:
    """Every session folded to its end: status, iterations, best value and configurations, and the steps taken.

    ``iterations`` has session, strategy, target_metric, target, the metrics of STEP_METRICS and the columns of
    SESSION_CONFIG with the initial configuration (null for the default). Advised steps are applied before the next
    iteration. A session keeps at most ``max_iterations`` rows, so its array is small.
    """
    config = F.struct(
        *[F.coalesce(F.col(c).cast("double"), F.lit(ranges[p][0])).alias(c) for c, p in SESSION_CONFIG.items()]
    )
    row = F.struct(
        F.col("iteration"),
        F.col("target").cast("double").alias("target"),
        *[F.col(m).cast("double").alias(m) for m in STEP_METRICS],
    )
    sessions = (
        first_iterations(iterations, order, max_iterations)
        .groupBy("session")
        .agg(
            F.array_sort(F.collect_list(row)).alias("rows"),
            F.min_by(config, "iteration").alias("cfg"),
            F.min("strategy").alias("strategy"),
            F.min("target_metric").alias("target_metric"),
        )
    )
    lower, on_cost = lower_is_better(F.col("target_metric")), F.col("target_metric") == "cost"

    def config_of(state: Column, row: Column, go_on: Column) -> Column:
        planned = _steps(state["cfg"], row, F.col("strategy"), on_cost, ranges)
        return F.struct(
            *[
                F.when(go_on & planned[c][0], planned[c][1]).otherwise(state["cfg"][c]).alias(c)
                for c in SESSION_CONFIG
            ]
        )

    def changed(state: Column, row: Column, go_on: Column) -> Column:
        planned = _steps(state["cfg"], row, F.col("strategy"), on_cost, ranges)
        count = F.lit(0)
        for c in SESSION_CONFIG:
            when, new, _ = planned[c]
            count = count + F.when(go_on & when & (new != state["cfg"][c]), 1).otherwise(0)
        return count

    def step(state: Column, row: Column) -> Column:
        x, best = row["target"], state["best_value"]
        first = best.isNull()
        better = F.coalesce(F.when(lower, x < best).otherwise(x > best), F.lit(False))
        gain = F.abs(x - best) / F.greatest(F.abs(best), F.lit(1.0))
        converged = ~first & better & (gain < convergence)
        iterations_done = F.when(converged, state["iterations"]).otherwise(state["iterations"] + 1)
        ended = converged | (iterations_done >= max_iterations)
        advanced = F.struct(
            F.when(ended, F.lit("completed")).otherwise(F.lit("active")).alias("status"),
            iterations_done.alias("iterations"),
            F.when(first | better, x).otherwise(best).alias("best_value"),
            F.when(first | better, state["cfg"]).otherwise(state["best_cfg"]).alias("best_cfg"),
            config_of(state, row, ~ended).alias("cfg"),
            (state["adjustments"] + changed(state, row, ~ended)).alias("adjustments"),
        )
        return F.when(state["status"] == "active", advanced).otherwise(state)

    start = F.struct(
        F.lit("active").alias("status"),
        F.lit(0).alias("iterations"),
        F.lit(None).cast("double").alias("best_value"),
        F.col("cfg").alias("best_cfg"),
        F.col("cfg").alias("cfg"),
        F.lit(0).alias("adjustments"),
    )
    return sessions.withColumn("s", F.aggregate("rows", start, step)).select(
        "session", "strategy", "target_metric", "s.*"
    )


def running_best(iterations: DataFrame, order: Sequence[str], block: Column | None = None) -> DataFrame:
    """Best target value up to and before every row of a session, for sessions of any length."""
    rows = iterations.filter(F.col("target").isNotNull()).withColumn("_lower", lower_is_better(F.col("target_metric")))
    both = {"_lo": ("min", F.col("target")), "_hi": ("max", F.col("target"))}
    out = with_running(rows, ["session"], block, order, both)
    out = out.withColumn("best_so_far", F.when(F.col("_lower"), F.col("_lo")).otherwise(F.col("_hi"))).drop("_lo", "_hi")
    out = with_running(out, ["session"], block, order, both, inclusive=False)
    return out.withColumn("best_before", F.when(F.col("_lower"), F.col("_lo")).otherwise(F.col("_hi"))).drop(
        "_lo", "_hi", "_lower"
    )


def converges() -> Column:
    """True where a row improves on the best before it by less than the threshold."""
    gain = F.abs(F.col("target") - F.col("best_before")) / F.greatest(F.abs(F.col("best_before")), F.lit(1.0))
    improves = F.col("best_so_far") != F.col("best_before")
    return F.coalesce(improves & (gain < CONVERGENCE), F.lit(False))


# Session life ------------------------------------------------------------------


def session_status(events: DataFrame, key: str = "session") -> DataFrame:
    """Status after start, pause, resume and end events (kind, at): ended for good by the first end."""
    at = F.col("at")
    ends = events.groupBy(key).agg(F.min(F.when(F.col("kind") == "end", at)).alias("ended_at"))
    moves = events.filter(F.col("kind") != "end").join(ends, key)
    live = moves.filter(F.col("ended_at").isNull() | (at < F.col("ended_at")))
    last = live.groupBy(key).agg(F.max_by("kind", at).alias("last"))
    return ends.join(last, key, "left").select(
        key,
        F.when(F.col("ended_at").isNotNull(), "completed")
        .when(F.col("last") == "pause", "paused")
        .otherwise("active")
        .alias("status"),
    )


def session_starts(events: DataFrame, key: str, order: Sequence[str], block: Column | None = None) -> DataFrame:
    """Start events that open a session: one that comes while an active session exists is answered by that one."""
    place = F.struct(*order)

    def when(kind: str) -> tuple[str, Column]:
        return "max", F.when(F.col("kind") == kind, place)

    kinds = ["start", "pause", "resume", "end"]
    rows = with_running(events, [key], block, order, {f"_{k}": when(k) for k in kinds}, inclusive=False)
    open_now = F.col("_start").isNotNull() & (F.col("_end").isNull() | (F.col("_start") > F.col("_end")))
    moving = F.greatest("_start", F.when(F.col("_resume") > F.col("_start"), F.col("_resume")))
    paused = F.col("_pause").isNotNull() & (F.col("_pause") > moving)
    active = F.coalesce(open_now & ~paused, F.lit(False))
    return rows.filter((F.col("kind") == "start") & ~active).drop(*[f"_{k}" for k in kinds])


# Configurations ------------------------------------------------------------------


def constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(k, *v) for k, v in CONSTRAINTS.items()],
        "parameter string, type string, min_value double, max_value double, default_value double",
    )


Validator = Callable[[Column, Column], Column]


def validate(entries: DataFrame, rules: DataFrame, validators: Sequence[Validator] = ()) -> DataFrame:
    """Add ``valid`` to entries (parameter, number, flag): numbers for numeric types in range, flags for booleans.

    A custom validator gives a predicate of parameter and number; null counts as invalid.
    """
    joined = entries.join(rules, "parameter", "left")
    kind = F.col("type")
    whole = F.when(
        kind.isin("integer", "memory"),
        F.when(F.col("number") < 0, F.ceil("number")).otherwise(F.floor("number")).cast("double"),
    ).otherwise(F.col("number"))
    typed = F.when(kind == "boolean", F.col("flag").isNotNull()).otherwise(F.col("number").isNotNull())
    low = F.col("min_value").isNull() | F.coalesce(whole >= F.col("min_value"), F.lit(False))
    high = F.col("max_value").isNull() | F.coalesce(whole <= F.col("max_value"), F.lit(False))
    valid = kind.isNull() | (typed & low & high)
    for v in validators:
        valid = valid & F.coalesce(v(F.col("parameter"), F.col("number")), F.lit(False))
    return joined.withColumn("valid", valid)


def validity(validated: DataFrame, key: str) -> DataFrame:
    """Is every entry of a configuration valid?"""
    return validated.groupBy(key).agg(
        F.bool_and("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid_entries")
    )


def constrained(number: Column, kind: Column, low: Column, high: Column) -> Column:
    """Value converted by type and pulled into range."""
    typed = F.when(kind.isin("integer", "memory"), F.floor(number).cast("double")).otherwise(number)
    return clamp(typed, F.coalesce(low, F.lit(float("-inf"))), F.coalesce(high, F.lit(float("inf"))))


def suggest_related(configs: DataFrame) -> DataFrame:
    """Values for the parameters that go with memory, cores and executors. 10 %, 384 MB, factor 2."""
    m, c, n = F.col("executor_memory_mb"), F.col("executor_cores"), F.col("num_executors")
    dynamic = F.col("dynamic_allocation")
    return configs.withColumns(
        {
            "memory_overhead": F.greatest(F.lit(384).cast("long"), F.floor(m * 0.1).cast("long")),
            "parallelism": (c * n * 2).cast("long"),
            "min_executors": F.when(dynamic, F.greatest(F.lit(1).cast("long"), F.floor(n / 2).cast("long"))),
            "max_executors": F.when(dynamic, (n * 2).cast("long")),
        }
    )


#: Changes, or composed maps of changes, that a node of the tree has below it.
CHUNK = 32


def replay(changes: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None) -> DataFrame:
    """Change log with ``old_value`` and ``new_value`` for increase, decrease, set and reset requests.

    ``changes`` has action, amount and the constraint columns of its parameter. A request maps a value x to
    min(high, max(low, x + shift)); such maps compose to one of the same form. So the requests of a key are the leaves of
    a tree: every ``CHUNK`` neighbours are composed to one map, these again, up to one root, and on the way down every
    node hands each of its children the value that it starts from. No array is longer than ``CHUNK``, and a key with very
    many requests is worked on in many tasks, in as many rounds as its tree has levels.
    """
    keys = list(keys)
    a = F.col("action")
    step = F.coalesce(F.nullif(F.col("amount"), F.lit(0.0)), F.when(F.col("type") == "float", 0.1).otherwise(1.0))
    target = F.when(a == "reset", F.col("default_value")).when(a == "set", F.col("amount"))
    # least and greatest skip nulls, so an action without a target must not reach them
    fixed = F.when(
        a.isin("set", "reset"), constrained(target, F.col("type"), F.col("min_value"), F.col("max_value"))
    )
    rows = changes.withColumns(
        {
            "_shift": F.when(a == "increase", step).when(a == "decrease", -step).otherwise(F.lit(0.0)),
            "_low": F.coalesce(fixed, F.col("min_value"), F.lit(float("-inf"))),
            "_high": F.coalesce(fixed, F.col("max_value"), F.lit(float("inf"))),
        }
    )
    identity = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("l"), F.lit(float("inf")).alias("h"))

    def apply(f: Column, x: Column) -> Column:
        return F.least(f["h"], F.greatest(f["l"], x + f["s"]))

    def after(f: Column, g: Column) -> Column:
        """First f, then g."""
        return F.struct((f["s"] + g["s"]).alias("s"), apply(g, f["l"]).alias("l"), apply(g, f["h"]).alias("h"))

    payload = [c for c in changes.columns if c not in keys]
    numbered = with_running(rows, keys, block, order, {"_no": ("sum", F.lit(1))})
    own = F.struct(F.col("_shift").alias("s"), F.col("_low").alias("l"), F.col("_high").alias("h"))
    level = stored(numbered.select(*keys, (F.col("_no") - 1).alias("_at"), own.alias("_f"), F.struct(*payload).alias("_row")), "changes")
    most, nodes = (level.agg(F.max("_at")).first()[0] or 0) + 1, []
    while not nodes or most > 1:
        child = F.struct("_at", "_f", *(["_row"] if not nodes else []))
        above = level.groupBy(*keys, F.floor(F.col("_at") / CHUNK).cast("long").alias("_up")).agg(F.array_sort(F.collect_list(child)).alias("_below"))
        nodes.append(stored(above.withColumn("_f", F.aggregate("_below", identity, lambda f, c: after(f, c["_f"]))), "changes"))
        level, most = nodes[-1].select(*keys, F.col("_up").alias("_at"), "_f"), -(-most // CHUNK)
    # A value never set counts as zero.
    starts = nodes[-1].select(*keys, "_up", F.lit(0.0).alias("_start"))
    for depth, node in reversed(list(enumerate(nodes))):

        def start_of(child: Column, place: Column) -> Column:
            begun = F.aggregate(F.slice("_below", F.lit(1), place), F.col("_start"), lambda x, c: apply(c["_f"], x))
            return F.struct(child.alias("c"), begun.alias("x"))

        opened = node.join(starts, [*keys, "_up"]).select(*keys, F.explode(F.transform("_below", start_of)).alias("_n"))
        starts = opened.select(*keys, F.col("_n.c._at").alias("_up"), F.col("_n.x").alias("_start"))
        if depth == 0:
            return opened.select(
                *keys,
                "_n.c._row.*",
                F.when(F.col("_n.c._at") > 0, F.col("_n.x")).alias("old_value"),
                apply(F.col("_n.c._f"), F.col("_n.x")).alias("new_value"),
            )


def rollback(log: DataFrame, config: str, order: Sequence[str], steps: int) -> DataFrame:
    """Values per parameter after undoing the last ``steps`` changes of every configuration; undone firsts vanish."""
    place = F.struct(*order)
    newest = W.partitionBy(config).orderBy(*[F.col(c).desc() for c in order])
    dropped = log.select(config, *order, F.row_number().over(newest).alias("_n")).filter(F.col("_n") <= steps)
    cutoff = dropped.groupBy(config).agg(F.min(place).alias("_cutoff"))
    kept = log.join(cutoff, config).filter(place < F.col("_cutoff"))
    return kept.groupBy(config, "parameter").agg(F.max_by("new_value", place).alias("value"))


def session_counters(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count_if(F.col("status") == "active").alias("active_sessions"),
        F.count_if(F.col("status") == "completed").alias("completed_sessions"),
        F.sum("adjustments").cast("long").alias("total_adjustments"),
    )


