"""Queries: tuning sessions, configuration checks, feedback and learned patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even, long_sum, ratio
from jobsight.operators import cost, feedback, tuning
from jobsight.operators.ordered import with_running
from jobsight.plans.costs import COST_SQL
from jobsight.plans.diagnosis import jobs, r
from jobsight.plans.registry import query
from jobsight.session import shared_dir, stored
from jobsight.sources import sinks
from jobsight.streaming import feeds, processors

ORDER = ["seq", "tie"]


def iterations(t):
    """The runs of one customer in time order are the iterations of one tuning session."""
    a = jobs(t)
    seconds = F.col("duration_ms") / 1000.0
    spilled = F.col("memory_spilled_bytes") + F.col("disk_spilled_bytes")
    throughput = F.col("total_tasks") / seconds
    s = cost.run_shape()
    shape = cost.Shape(s.executors, s.cores, s.memory_mb, s.driver_mb, s.hours)
    metric = F.expr("CASE cust_key % 3 WHEN 0 THEN 'duration' WHEN 1 THEN 'cost' ELSE 'throughput' END")
    target = F.when(metric == "duration", seconds).when(metric == "cost", cost.total_cost(shape)).otherwise(throughput)
    return a.select(
        F.col("cust_key").alias("session"),
        F.col("start_ms").alias("seq"),
        F.col("app_key").alias("tie"),
        metric.alias("target_metric"),
        F.expr(
            "CASE cust_key % 4 WHEN 0 THEN 'conservative' WHEN 1 THEN 'aggressive' ELSE 'moderate' END"
        ).alias("strategy"),
        # a running job has no target yet
        F.when(F.col("status") != "running", target).alias("target"),
        ratio("memory_spilled_bytes", "input_bytes").alias("memory_spill_ratio"),
        F.col("disk_spilled_bytes").cast("double").alias("disk_spill_bytes"),
        (ratio("jvm_gc_time_ms", "executor_run_time_ms") * 100).alias("gc_time_percent"),
        (ratio("executor_cpu_time_ms", "executor_run_time_ms") * 100).alias("cpu_utilization"),
        ratio(spilled, "shuffle_write_bytes").alias("shuffle_spill_ratio"),
        ratio("failed_tasks", "total_tasks").alias("task_failure_rate"),
        throughput.alias("task_throughput"),
        F.expr("CASE WHEN cust_key % 2 = 0 THEN 8192.0D END").alias("executor_memory"),
        F.lit(None).cast("double").alias("memory_fraction"),
        F.lit(None).cast("double").alias("parallelism"),
        F.lit(None).cast("double").alias("shuffle_partitions"),
        F.expr("CASE WHEN cust_key % 5 = 0 THEN 8.0D END").alias("executor_cores"),
        F.lit(None).cast("double").alias("executor_instances"),
    )


_ITERATIONS = """
SELECT cust_key AS session, start_ms AS seq, app_key AS tie,
  CASE cust_key % 3 WHEN 0 THEN 'duration' WHEN 1 THEN 'cost' ELSE 'throughput' END AS target_metric,
  CASE cust_key % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS factor,
  CASE WHEN status <> 'running' THEN CASE cust_key % 3 WHEN 0 THEN duration_ms / 1000e0 WHEN 1 THEN config_cost
    ELSE total_tasks / (duration_ms / 1000e0) END END AS target,
  CASE WHEN input_bytes > 0 THEN CAST(memory_spilled_bytes AS DOUBLE) / input_bytes ELSE 0e0 END AS spill,
  disk_spilled_bytes AS disk, CAST(jvm_gc_time_ms AS DOUBLE) / executor_run_time_ms * 100 AS gc,
  CAST(executor_cpu_time_ms AS DOUBLE) / executor_run_time_ms * 100 AS cpu,
  CASE WHEN shuffle_write_bytes > 0 THEN CAST(memory_spilled_bytes + disk_spilled_bytes AS DOUBLE) / shuffle_write_bytes
    ELSE 0e0 END AS shuffle_spill,
  CAST(failed_tasks AS DOUBLE) / total_tasks AS failure, total_tasks / (duration_ms / 1000e0) AS throughput
FROM run_costs"""
_NUMBERED = """
SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq, tie) AS i FROM iterations WHERE target IS NOT NULL"""
_FOLD = """
SELECT DISTINCT session, CAST(0 AS BIGINT) AS i, 'active' AS status, CAST(0 AS BIGINT) AS iterations, CAST(NULL AS DOUBLE) AS best,
  CASE WHEN session % 2 = 0 THEN 8192e0 ELSE 4096e0 END AS mem, 0.6e0 AS frac, 100e0 AS par, 200e0 AS parts,
  CASE WHEN session % 5 = 0 THEN 8e0 ELSE 4e0 END AS cores, 5e0 AS inst, CAST(NULL AS DOUBLE) AS best_mem, CAST(0 AS BIGINT) AS changes
FROM numbered
UNION ALL
SELECT session, i, status2, iterations2, best2, mem2, frac2, par2, parts2, cores2, inst2, best_mem2,
  changes + CAST(mem2 <> mem AS BIGINT) + CAST(frac2 <> frac AS BIGINT) + CAST(par2 <> par AS BIGINT) + CAST(parts2 <> parts AS BIGINT)
    + CAST(cores2 <> cores AS BIGINT) + CAST(inst2 <> inst AS BIGINT)
FROM (
  SELECT *, CASE WHEN go AND (spill > 0.1e0 OR disk > 0) THEN least(mem + floor(1024 * factor), 32768e0) ELSE mem END AS mem2,
    CASE WHEN go AND gc > 10 THEN round_even(greatest(frac - 0.05e0 * factor, 0.3e0) * 100, 0) / 100 ELSE frac END AS frac2,
    CASE WHEN go AND cpu < 50 THEN least(par + floor(10 * factor), 1000e0) ELSE par END AS par2,
    CASE WHEN go AND shuffle_spill > 0.2e0 THEN least(parts + floor(50 * factor), 2000e0) ELSE parts END AS parts2,
    CASE WHEN go AND failure > 0.05e0 THEN greatest(cores - floor(1 * factor), 1e0) ELSE cores END AS cores2,
    CASE WHEN go AND target_metric = 'cost' AND throughput > 0 AND failure < 0.01e0 THEN greatest(inst - 1, 1e0) ELSE inst END AS inst2,
    CASE WHEN go THEN 'active' ELSE 'completed' END AS status2
  FROM (
    SELECT *, NOT converged AND iterations2 < 20 AS go, CASE WHEN best IS NULL OR better THEN target ELSE best END AS best2,
      CASE WHEN best IS NULL OR better THEN mem ELSE best_mem END AS best_mem2
    FROM (
      SELECT *, iterations + CASE WHEN converged THEN 0 ELSE 1 END AS iterations2 FROM (
        SELECT *, better AND abs(target - best) / greatest(abs(best), 1e0) < 0.02e0 AS converged FROM (
          SELECT f.session, n.i, f.iterations, f.best, f.mem, f.frac, f.par, f.parts, f.cores, f.inst, f.best_mem, f.changes,
            n.target, n.target_metric, n.factor, n.spill, n.disk, n.gc, n.cpu, n.shuffle_spill, n.failure, n.throughput,
            coalesce(CASE WHEN n.target_metric = 'throughput' THEN n.target > f.best ELSE n.target < f.best END, false) AS better
          FROM fold f JOIN numbered n ON n.session = f.session AND n.i = f.i + 1 WHERE f.status = 'active') a) b) c) d) e"""
_SESSIONS = "SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY session ORDER BY i DESC) = 1"
TUNING_SQL = {**COST_SQL, "iterations": _ITERATIONS, "numbered": _NUMBERED, "fold": _FOLD, "sessions": _SESSIONS}


def tuned(name: str, sql: str | None, recursive: bool = True):
    extra = TUNING_SQL if recursive else {k: v for k, v in TUNING_SQL.items() if k not in ("fold", "sessions")}
    return query(name, sql, extra, recursive)


def _sessions(t):
    return tuning.run_sessions(iterations(t), ORDER)


@tuned(
    "tun_02_session_outcome",
    f"SELECT session, status, iterations, {r('best')} AS best_value, changes AS adjustments FROM sessions",
)
def _(t):
    return _sessions(t).select(
        "session",
        "status",
        F.col("iterations").cast("long"),
        half_even("best_value", 6).alias("best_value"),
        F.col("adjustments").cast("long"),
    )


@tuned(
    "tun_04_applied_config",
    f"""SELECT session, mem AS executor_memory, {r('frac', 2)} AS memory_fraction, par AS parallelism, parts AS shuffle_partitions,
      cores AS executor_cores, inst AS executor_instances FROM sessions""",
)
def _(t):
    out = _sessions(t).select("session", "cfg.*")
    return out.withColumn("memory_fraction", half_even("memory_fraction", 2))


@tuned("tun_06_best_config", f"SELECT session, best_mem AS executor_memory, {r('best')} AS best_value FROM sessions")
def _(t):
    return _sessions(t).select("session", "best_cfg.executor_memory", half_even("best_value", 6).alias("best_value"))


@tuned(
    "tun_03_step_rules",
    """SELECT session, tie, CAST((spill > 0.1e0 OR disk > 0) AS INT) * CAST(floor(1024 * factor) > 0 AS INT)
      + CAST(gc > 10 AS INT) + CAST(cpu < 50 AS INT) + CAST(shuffle_spill > 0.2e0 AS INT)
      + CAST(failure > 0.05e0 AND floor(factor) > 0 AS INT)
      + CAST(target_metric = 'cost' AND throughput > 0 AND failure < 0.01e0 AS INT) AS steps FROM iterations""",
    recursive=False,
)
def _(t):
    """Steps every iteration would ask for from the default configuration."""
    config = F.struct(
        *[F.lit(tuning.TUNABLE[p][0]).alias(c) for c, p in tuning.SESSION_CONFIG.items()]
    )
    rows = iterations(t).withColumn("m", F.struct(*tuning.STEP_METRICS)).withColumn("cfg", config)
    steps = tuning.adjustments(F.col("cfg"), F.col("m"), F.col("strategy"), F.col("target_metric"))
    return rows.select("session", "tie", F.size(steps).alias("steps"))


_BETTER = "CASE WHEN target_metric = 'throughput' THEN max(target) OVER {w} ELSE min(target) OVER {w} END"
_W = "(PARTITION BY session ORDER BY seq, tie ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"


@tuned(
    "win_04_running_best",
    f"""SELECT session, tie, {r(_BETTER.format(w=_W.format(end='CURRENT ROW')))} AS best_so_far FROM numbered""",
    recursive=False,
)
def _(t):
    out = tuning.running_best(iterations(t), ORDER)
    return out.select("session", "tie", half_even("best_so_far", 6).alias("best_so_far"))


@tuned(
    "win_05_convergence",
    f"""SELECT session, MIN(i) FILTER (converges) AS first_hit, COUNT(*) FILTER (converges) AS hits FROM (
      SELECT *, best_now <> best_old AND abs(target - best_old) / greatest(abs(best_old), 1e0) < 0.02e0 AS converges FROM (
        SELECT *, {_BETTER.format(w=_W.format(end='CURRENT ROW'))} AS best_now,
          {_BETTER.format(w=_W.format(end='1 PRECEDING'))} AS best_old FROM numbered) x) y
    GROUP BY session""",
    recursive=False,
)
def _(t):
    rows = tuning.running_best(iterations(t), ORDER)
    hit = rows.withColumn("hit", tuning.converges())
    return (
        with_running(hit, ["session"], None, ORDER, {"i": ("sum", F.lit(1))})
        .groupBy("session")
        .agg(F.min(F.when(F.col("hit"), F.col("i"))).cast("long").alias("first_hit"), F.count_if("hit").alias("hits"))
    )


@tuned(
    "win_06_iteration_cap",
    "SELECT session, tie, i AS iteration, i = 20 AS capped FROM numbered WHERE i <= 20",
    recursive=False,
)
def _(t):
    out = tuning.first_iterations(iterations(t), ORDER)
    return out.select(
        "session",
        "tie",
        F.col("iteration").cast("long"),
        (F.col("iteration") == tuning.MAX_ITERATIONS).alias("capped"),
    )


@tuned(
    "flt_21_sessions_by_status",
    """SELECT session, iterations FROM sessions JOIN (SELECT session, MIN(seq) AS started FROM numbered GROUP BY session) s
      USING (session) WHERE status = 'active' ORDER BY started DESC, session""",
)
def _(t):
    started = iterations(t).filter(F.col("target").isNotNull()).groupBy("session").agg(F.min("seq").alias("started"))
    live = _sessions(t).filter(F.col("status") == "active").join(started, "session")
    return live.orderBy(F.desc("started"), "session").select("session", F.col("iterations").cast("long"))


@tuned(
    "agg_22_session_counters",
    """SELECT COUNT(*) FILTER (status = 'active') AS active_sessions, COUNT(*) FILTER (status = 'completed') AS completed_sessions,
      CAST(SUM(changes) AS BIGINT) AS total_adjustments FROM sessions""",
)
def _(t):
    return tuning.session_counters(_sessions(t))


@tuned(
    "str_11_online_sessions",
    f"SELECT session, status, iterations, {r('best')} AS best_value, changes AS adjustments FROM sessions",
)
def _(t):
    """The sessions followed live: iterations read as a stream, one state per session."""
    table = iterations(t).filter(F.col("target").isNotNull())
    landed = shared_dir(t.spark, "iterations")
    table.write.parquet(landed)
    stream = feeds.stream_files(t.spark, landed, table.schema)
    out = feeds.drain(processors.tuning_sessions(stream), "sessions", "update", ["session"])
    return out.select(
        "session",
        "status",
        F.col("iterations").cast("long"),
        half_even("best_value", 6).alias("best_value"),
        F.col("adjustments").cast("long"),
    )


# Session life -------------------------------------------------------------------

_EVENTS = """
SELECT cust_key AS session, app_key AS event, start_ms,
  CASE WHEN status = 'failed' AND priority = 'cost' THEN 'end' WHEN priority = 'balanced' THEN 'start'
    WHEN priority = 'cost' THEN 'pause' ELSE 'resume' END AS kind,
  row_number() OVER (PARTITION BY cust_key ORDER BY start_ms, app_key) AS n FROM order_info"""


def session_events(t):
    return t.orders.select(
        F.col("cust_key").alias("session"),
        F.col("app_key").alias("event"),
        "start_ms",
        F.expr(
            "CASE WHEN status = 'failed' AND priority = 'cost' THEN 'end' WHEN priority = 'balanced' THEN 'start'"
            " WHEN priority = 'cost' THEN 'pause' ELSE 'resume' END"
        ).alias("kind"),
    )


@query(
    "tun_01_session_starts",
    """SELECT session, event FROM (SELECT *, max(CASE WHEN kind = 'start' THEN n END) OVER w AS ls,
        max(CASE WHEN kind = 'pause' THEN n END) OVER w AS lp, max(CASE WHEN kind = 'resume' THEN n END) OVER w AS lr,
        max(CASE WHEN kind = 'end' THEN n END) OVER w AS le FROM session_events
        WINDOW w AS (PARTITION BY session ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
    WHERE kind = 'start' AND NOT (coalesce(ls, 0) > coalesce(le, 0)
      AND NOT (coalesce(lp, 0) > greatest(ls, CASE WHEN lr > ls THEN lr ELSE 0 END)))""",
    {"session_events": _EVENTS},
)
def _(t):
    out = tuning.session_starts(session_events(t), "session", ["start_ms", "event"])
    return out.select("session", "event")


@query(
    "tun_05_session_status",
    """SELECT session, CASE WHEN ended IS NOT NULL THEN 'completed' WHEN last = 'pause' THEN 'paused' ELSE 'active' END AS status
    FROM (SELECT session, MIN(n) FILTER (kind = 'end') AS ended, arg_max(kind, n) FILTER (kind <> 'end') AS last
      FROM session_events GROUP BY session) x""",
    {"session_events": _EVENTS},
)
def _(t):
    events = session_events(t).withColumn("at", F.struct("start_ms", "event"))
    return tuning.session_status(events)


# Configurations -------------------------------------------------------------------

_ENTRIES = """
SELECT app_key, parameter, number, flag FROM order_info, LATERAL (
  SELECT 'spark.executor.memory' AS parameter, CAST(executor_memory_mb * 5 AS DOUBLE) AS number, CAST(NULL AS BOOLEAN) AS flag
  UNION ALL SELECT 'spark.executor.cores', CAST(executor_cores AS DOUBLE), NULL
  UNION ALL SELECT 'spark.memory.fraction', CAST(num_executors AS DOUBLE) / 20, NULL
  UNION ALL SELECT 'spark.shuffle.compress', CASE WHEN priority = 'cost' THEN 1e0 END, CASE WHEN priority <> 'cost' THEN true END
  UNION ALL SELECT 'spark.custom.' || priority, CAST(num_executors AS DOUBLE), NULL) e"""
_VALID = """
SELECT e.*, CASE parameter WHEN 'spark.executor.memory' THEN number BETWEEN 512 AND 65536
  WHEN 'spark.executor.cores' THEN number BETWEEN 1 AND 32
  WHEN 'spark.memory.fraction' THEN number BETWEEN 0.1e0 AND 0.95e0
  WHEN 'spark.shuffle.compress' THEN flag IS NOT NULL ELSE true END AS valid FROM entries e"""


def entries(t):
    none = F.lit(None).cast("boolean").alias("flag")

    def entry(parameter, number, flag=none):
        return F.struct(parameter.alias("parameter"), number.cast("double").alias("number"), flag.alias("flag"))

    items = F.array(
        entry(F.lit("spark.executor.memory"), F.col("executor_memory_mb") * 5),
        entry(F.lit("spark.executor.cores"), F.col("executor_cores")),
        entry(F.lit("spark.memory.fraction"), F.col("num_executors") / 20.0),
        entry(
            F.lit("spark.shuffle.compress"),
            F.when(F.col("priority") == "cost", 1.0),
            F.when(F.col("priority") != "cost", F.lit(True)),
        ),
        entry(F.concat(F.lit("spark.custom."), "priority"), F.col("num_executors")),
    )
    return t.orders.select("app_key", F.inline(items))


def checked(name: str, sql: str):
    return query(name, sql, {"entries": _ENTRIES, "validated": _VALID})


@checked("join_09_entry_constraints", "SELECT app_key, parameter, number, valid FROM validated")
def _(t):
    out = tuning.validate(entries(t), tuning.constraints(t.spark))
    return out.select("app_key", "parameter", "number", "valid")


@checked(
    "tun_08_config_validity",
    "SELECT app_key, bool_and(valid) AS valid, COUNT(*) FILTER (NOT valid) AS invalid_entries FROM validated GROUP BY app_key",
)
def _(t):
    return tuning.validity(tuning.validate(entries(t), tuning.constraints(t.spark)), "app_key")


@checked(
    "udx_02_custom_validator",
    """SELECT app_key, parameter, valid AND coalesce(CASE WHEN parameter LIKE 'spark.custom.%' THEN number < 10 ELSE true END, false)
      AS valid FROM validated""",
)
def _(t):
    def small_custom(parameter, number):
        return F.when(parameter.startswith("spark.custom."), number < 10).otherwise(F.lit(True))

    out = tuning.validate(entries(t), tuning.constraints(t.spark), [small_custom])
    return out.select("app_key", "parameter", "valid")


@checked(
    "tun_07_parameter_ranges",
    """SELECT parameter, COUNT(*) AS entries, COUNT(*) FILTER (number < lo OR number > hi) AS outside
    FROM entries JOIN (VALUES ('spark.executor.memory', 1024e0, 16384e0), ('spark.executor.cores', 1e0, 16e0),
      ('spark.memory.fraction', 0.4e0, 0.9e0)) p(parameter, lo, hi) USING (parameter) GROUP BY parameter""",
)
def _(t):
    """Tunable ranges, two of them overridden, applied to the configurations of all runs."""
    changed = t.spark.createDataFrame(
        [("spark.executor.memory", None, 16384.0, None), ("spark.memory.fraction", 0.4, None, 0.1)],
        "parameter string, min_value double, max_value double, step_size double",
    )
    ranges = tuning.parameters(t.spark, changed)
    joined = entries(t).join(F.broadcast(ranges), "parameter")
    outside = (F.col("number") < F.col("min_value")) | (F.col("number") > F.col("max_value"))
    return joined.groupBy("parameter").agg(F.count(F.lit(1)).alias("entries"), F.count_if(outside).alias("outside"))


@query(
    "tun_11_related_parameters",
    """SELECT app_key, greatest(384, CAST(floor(executor_memory_mb * 0.1e0) AS BIGINT)) AS memory_overhead,
      executor_cores * num_executors * 2 AS parallelism,
      CASE WHEN cluster_type = 'shared' THEN greatest(1, num_executors // 2) END AS min_executors,
      CASE WHEN cluster_type = 'shared' THEN num_executors * 2 END AS max_executors FROM order_info""",
)
def _(t):
    configs = t.orders.withColumn("dynamic_allocation", F.col("cluster_type") == "shared")
    out = tuning.suggest_related(configs)
    return out.select("app_key", "memory_overhead", "parallelism", "min_executors", "max_executors")


_CHANGES = """
SELECT cust_key AS config, app_key AS event, start_ms,
  CASE app_key % 3 WHEN 0 THEN 'spark.executor.memory' WHEN 1 THEN 'spark.executor.cores' ELSE 'spark.memory.fraction' END AS parameter,
  CASE WHEN status = 'completed' THEN 'increase' WHEN status = 'running' THEN 'decrease'
    WHEN cust_key % 2 = 0 THEN 'set' ELSE 'reset' END AS action,
  CASE app_key % 3 WHEN 0 THEN CAST(executor_memory_mb AS DOUBLE) WHEN 1 THEN CAST(executor_cores AS DOUBLE)
    ELSE num_executors / 50e0 END AS amount,
  CASE app_key % 3 WHEN 0 THEN 512e0 WHEN 1 THEN 1e0 ELSE 0.1e0 END AS lo,
  CASE app_key % 3 WHEN 0 THEN 65536e0 WHEN 1 THEN 32e0 ELSE 0.95e0 END AS hi,
  CASE app_key % 3 WHEN 0 THEN 4096e0 WHEN 1 THEN 4e0 ELSE 0.6e0 END AS def FROM order_info"""
_REPLAY = """
SELECT config, parameter, event, start_ms, n, CAST(NULL AS DOUBLE) AS old_value, greatest(lo, least(hi, CASE action WHEN 'increase' THEN amount
    WHEN 'decrease' THEN -amount WHEN 'set' THEN amount ELSE def END)) AS new_value FROM ordered_changes WHERE n = 1
UNION ALL
SELECT c.config, c.parameter, c.event, c.start_ms, c.n, p.new_value, greatest(lo, least(hi, CASE action WHEN 'increase' THEN p.new_value + amount
    WHEN 'decrease' THEN p.new_value - amount WHEN 'set' THEN amount ELSE def END))
FROM replayed p JOIN ordered_changes c ON c.config = p.config AND c.parameter = p.parameter AND c.n = p.n + 1"""
CHANGE_SQL = {
    "changes": _CHANGES,
    "ordered_changes": "SELECT *, row_number() OVER (PARTITION BY config, parameter ORDER BY start_ms, event) AS n FROM changes",
    "replayed": _REPLAY,
}


def change_log(t):
    raw = t.orders.select(
        F.col("cust_key").alias("config"),
        F.col("app_key").alias("event"),
        "start_ms",
        F.expr(
            "CASE app_key % 3 WHEN 0 THEN 'spark.executor.memory' WHEN 1 THEN 'spark.executor.cores'"
            " ELSE 'spark.memory.fraction' END"
        ).alias("parameter"),
        F.expr(
            "CASE WHEN status = 'completed' THEN 'increase' WHEN status = 'running' THEN 'decrease'"
            " WHEN cust_key % 2 = 0 THEN 'set' ELSE 'reset' END"
        ).alias("action"),
        F.expr(
            "CASE app_key % 3 WHEN 0 THEN CAST(executor_memory_mb AS DOUBLE) WHEN 1 THEN CAST(executor_cores AS DOUBLE)"
            " ELSE num_executors / 50.0D END"
        ).alias("amount"),
    )
    limits = tuning.constraints(t.spark)
    typed = raw.join(F.broadcast(limits), "parameter")
    return tuning.replay(typed, ["config", "parameter"], ["start_ms", "event"])


@query(
    "tun_09_change_log",
    f"SELECT config, parameter, event, {r('old_value')} AS old_value, {r('new_value')} AS new_value FROM replayed",
    CHANGE_SQL,
    recursive=True,
)
def _(t):
    return change_log(t).select(
        "config", "parameter", "event", half_even("old_value", 6).alias("old_value"), half_even("new_value", 6).alias("new_value")
    )


def _undone(name, steps):
    @query(
        name,
        f"""SELECT config, parameter, {r('arg_max(new_value, (start_ms, event))')} AS value FROM (
          SELECT *, row_number() OVER (PARTITION BY config ORDER BY start_ms DESC, event DESC) AS back FROM replayed) x
        WHERE back > {steps} GROUP BY config, parameter""",
        CHANGE_SQL,
        recursive=True,
    )
    def _(t):
        out = tuning.rollback(change_log(t), "config", ["start_ms", "event"], steps)
        return out.withColumn("value", half_even("value", 6))


_undone("tun_10_rollback", 1)
_undone("win_11_undo_last_changes", 3)


# Feedback -------------------------------------------------------------------------

_IMPROVED = """
SELECT *, CASE WHEN metric_before <> 0 THEN CASE WHEN metric_name IN ('duration', 'cost')
    THEN CAST(metric_before - metric_after AS DOUBLE) / metric_before * 100
    ELSE CAST(metric_after - metric_before AS DOUBLE) / metric_before * 100 END ELSE 0e0 END AS actual,
  'spark.executor.cores_' || CAST(executor_cores AS VARCHAR) || '-spark.executor.memory_' || CAST(executor_memory AS VARCHAR)
    AS config_key FROM feedback"""
_SCORED = """
SELECT *, actual > 0 OR (expected_improvement > 0 AND actual >= expected_improvement * 0.5e0) AS success FROM improved"""
_PATTERNS = """
SELECT *, CASE WHEN samples < 5 THEN 0e0 ELSE CAST(success_count AS DOUBLE) / samples * least(1e0, samples / 20e0) END AS confidence,
  CAST(success_count AS DOUBLE) / samples AS success_rate
FROM (SELECT config_key, COUNT(*) FILTER (success) AS success_count, COUNT(*) FILTER (NOT success) AS failure_count, COUNT(*) AS samples,
  AVG(actual) AS avg_improvement, arg_min(metric_name, (ts_ms, session_id, part_key)) AS metric,
  arg_min(metric_before, (ts_ms, session_id, part_key)) AS before FROM scored GROUP BY config_key) x"""
_CONDITIONS = """
SELECT *, CASE WHEN metric IN ('duration', 'cost') THEN 'gt' ELSE 'lt' END AS operator,
  CASE WHEN metric IN ('duration', 'cost') THEN before * 0.8e0 ELSE before * 1.2e0 END AS threshold FROM patterns"""
FEEDBACK_SQL = {"improved": _IMPROVED, "scored": _SCORED, "patterns": _PATTERNS, "conditions": _CONDITIONS}
FIRST = ["ts_ms", "session_id", "part_key"]


def learned(name: str, sql: str | None):
    return query(name, sql, FEEDBACK_SQL)


def observed(t):
    config = F.create_map(
        F.lit("spark.executor.memory"), F.col("executor_memory").cast("string"),
        F.lit("spark.executor.cores"), F.col("executor_cores").cast("string"),
    )
    return feedback.scored(t.feedback).withColumn("config_key", feedback.config_key(config))


def patterns(t):
    return feedback.learn(observed(t), "config_key", F.struct(*FIRST))


@learned(
    "tun_12_feedback_scores",
    f"SELECT session_id, part_key, app_key, ts_ms, metric_name, {r('actual')} AS actual_improvement, success FROM scored",
)
def _(t):
    return observed(t).select(
        "session_id", "part_key", "app_key", "ts_ms", "metric_name",
        half_even("actual_improvement", 6).alias("actual_improvement"), "success",
    )


@learned(
    "agg_09_learned_patterns",
    f"""SELECT config_key, success_count, failure_count, {r('avg_improvement')} AS avg_improvement, {r('confidence')} AS confidence,
      metric, operator, {r('threshold')} AS threshold FROM conditions""",
)
def _(t):
    return patterns(t).select(
        "config_key",
        "success_count",
        "failure_count",
        half_even("avg_improvement", 6).alias("avg_improvement"),
        half_even("confidence", 6).alias("confidence"),
        "condition.metric",
        "condition.operator",
        half_even("condition.threshold", 6).alias("threshold"),
    )


# the derived feedback is a coin toss, so the bar is set lower than the default
_LEAST = 0.38


@learned("flt_22_usable_patterns", f"SELECT config_key, samples FROM patterns WHERE samples >= 5 AND confidence >= {_LEAST}")
def _(t):
    return feedback.usable(patterns(t), min_confidence=_LEAST).select("config_key", "samples")


@learned(
    "agg_08_feedback_statistics",
    f"""SELECT total_feedback, {r('success_rate')} AS success_rate, {r('avg_improvement')} AS avg_improvement, patterns_learned,
      high_confidence_patterns FROM (SELECT COUNT(*) AS total_feedback, AVG(CAST(success AS INT)) AS success_rate,
        AVG(actual) AS avg_improvement FROM scored) a,
      (SELECT COUNT(*) AS patterns_learned, COUNT(*) FILTER (confidence >= {_LEAST}) AS high_confidence_patterns FROM patterns) b""",
)
def _(t):
    out = feedback.statistics(observed(t), patterns(t), _LEAST)
    return out.withColumns({c: half_even(c, 6) for c in ("success_rate", "avg_improvement")})


@learned(
    "win_09_running_improvement",
    f"""SELECT config_key, session_id, part_key, app_key, ts_ms, COUNT(*) OVER w AS observations, {r('AVG(actual) OVER w', 5)} AS mean_improvement
    FROM scored WINDOW w AS (PARTITION BY config_key ORDER BY ts_ms, session_id, part_key, app_key ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    out = feedback.running_improvement(
        observed(t), "config_key", [*FIRST, "app_key"]
    )
    return out.select(
        "config_key", "session_id", "part_key", "app_key", "ts_ms", "observations",
        half_even("mean_improvement", 5).alias("mean_improvement"),
    )


_MET = f"""
SELECT j.app_key, c.config_key, c.confidence FROM conditions c JOIN (
  SELECT app_key, 'duration' AS metric, duration_ms / 1000e0 AS value FROM order_info
  UNION ALL SELECT app_key, 'throughput', num_executors * 2000e0 FROM order_info
  UNION ALL SELECT app_key, 'cost', executor_cores * 3000e0 FROM order_info) j USING (metric)
WHERE c.samples >= 5 AND c.confidence >= {_LEAST}
  AND CASE operator WHEN 'gt' THEN value > threshold ELSE value < threshold END"""


def _live_metrics(t):
    return t.orders.select(
        "app_key",
        F.create_map(
            F.lit("duration"), F.col("duration_ms") / 1000.0, F.lit("throughput"), F.col("num_executors") * 2000.0,
            F.lit("cost"), F.col("executor_cores") * 3000.0,
        ).alias("metrics"),
    )


@query(
    "tun_13_learned_recommendation",
    f"""SELECT app_key, arg_min(config_key, (-confidence, config_key)) AS config_key, {r('MAX(confidence)')} AS confidence
    FROM met GROUP BY app_key""",
    {**FEEDBACK_SQL, "met": _MET},
)
def _(t):
    good = feedback.usable(patterns(t), min_confidence=_LEAST)
    out = feedback.recommend(_live_metrics(t), good, "config_key", "app_key")
    return out.withColumn("confidence", half_even("confidence", 6))


# Patterns with a condition for every metric that their feedback was about.
_EACH = """
SELECT config_key, metric_name AS metric, arg_min(metric_before, (ts_ms, session_id, part_key)) AS before FROM scored GROUP BY ALL"""
_ALL_CONDITIONS = f"""
SELECT e.config_key, confidence, e.metric, CASE WHEN e.metric IN ('duration', 'cost') THEN 'gt' ELSE 'lt' END AS operator,
  CASE WHEN e.metric IN ('duration', 'cost') THEN e.before * 0.8e0 ELSE e.before * 1.2e0 END AS threshold,
  COUNT(*) OVER (PARTITION BY e.config_key) AS needed
FROM each e JOIN patterns p USING (config_key) WHERE samples >= 5 AND confidence >= {_LEAST}"""
_FULLY_MET = """
SELECT app_key, config_key, ANY_VALUE(confidence) AS confidence, ANY_VALUE(needed) AS needed FROM (
  SELECT app_key, 'duration' AS metric, duration_ms / 1000e0 AS value FROM order_info
  UNION ALL SELECT app_key, 'throughput', num_executors * 2000e0 FROM order_info
  UNION ALL SELECT app_key, 'cost', executor_cores * 3000e0 FROM order_info) j
JOIN all_conditions c USING (metric) WHERE CASE operator WHEN 'gt' THEN value > threshold ELSE value < threshold END
GROUP BY app_key, config_key HAVING COUNT(*) = ANY_VALUE(needed)"""
_DIVIDED = {**FEEDBACK_SQL, "each": _EACH, "all_conditions": _ALL_CONDITIONS, "fully_met": _FULLY_MET}


def _with_conditions(t):
    seen = observed(t)
    good = feedback.usable(feedback.learn(seen, "config_key", F.struct(*FIRST)), min_confidence=_LEAST)
    return stored(good.join(feedback.learn_conditions(seen, "config_key", F.struct(*FIRST)), "config_key"), "patterns")


@query(
    "join_08_metrics_to_patterns",
    """SELECT config_key, ANY_VALUE(needed) AS conditions, COUNT(*) AS runs FROM fully_met GROUP BY config_key""",
    _DIVIDED,
)
def _(t):
    """Patterns all of whose conditions hold, with the number of runs they fit."""
    rules = _with_conditions(t)
    pairs, cells = feedback.matched(_live_metrics(t), rules, "config_key", "app_key")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    counts = pairs.join(sizes, "cell").groupBy("config_key").agg(long_sum("n").alias("runs"))
    return counts.join(rules.select("config_key", F.size("conditions").cast("long").alias("conditions")), "config_key")


@query(
    "join_08_best_pattern_of_all_conditions",
    f"""SELECT app_key, COUNT(*) AS patterns, arg_min(config_key, (-confidence, config_key)) AS config_key, {r('MAX(confidence)')} AS confidence
    FROM fully_met GROUP BY app_key""",
    _DIVIDED,
)
def _(t):
    """How many patterns fit a run, and the best of them."""
    rules = _with_conditions(t)
    metrics = _live_metrics(t)
    pairs, cells = feedback.matched(metrics, rules, "config_key", "app_key")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "config_key")).alias("b")
    found = pairs.join(rules.select("config_key", "confidence"), "config_key").groupBy("cell").agg(F.count(F.lit(1)).alias("patterns"), best)
    return cells.join(found, "cell").select("app_key", "patterns", "b.config_key", half_even(-F.col("b.c"), 6).alias("confidence"))


@learned("snk_08_pattern_export_import", f"SELECT config_key, success_count, {r('confidence')} AS confidence, operator FROM conditions")
def _(t):
    path = shared_dir(t.spark, "patterns")
    sinks.export_json(patterns(t), path)
    schema = (
        "config_key STRING, success_count BIGINT, failure_count BIGINT, avg_improvement DOUBLE, samples BIGINT,"
        " condition STRUCT<metric: STRING, operator: STRING, threshold: DOUBLE>, confidence DOUBLE"
    )
    back = sinks.import_json(t.spark, path, schema)
    return back.select("config_key", "success_count", half_even("confidence", 6).alias("confidence"), "condition.operator")


@learned(
    "str_10_online_patterns",
    f"SELECT config_key, success_count, failure_count, {r('avg_improvement')} AS avg_improvement, {r('confidence')} AS confidence FROM patterns",
)
def _(t):
    """The same patterns learned from the feedback as it streams in."""
    live = feedback.learn(observed(t.streaming("lineitem")), "config_key", F.struct(*FIRST))
    out = feeds.drain(live.drop("condition"), "patterns", "update", ["config_key"])
    return out.select(
        "config_key",
        "success_count",
        "failure_count",
        half_even("avg_improvement", 6).alias("avg_improvement"),
        half_even("confidence", 6).alias("confidence"),
    )


