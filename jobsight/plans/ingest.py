"""Queries: reading event logs and dumps, and writing the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions.numeric import MIB, half_even, ratio
from jobsight.plans import landed
from jobsight.plans.costs import imported_prices
from jobsight.plans.diagnosis import MEASURES, jobs, r
from jobsight.plans.registry import query
from jobsight.session import shared_dir
from jobsight.sources import catalogs as cat
from jobsight.sources import cluster_dumps as dumps
from jobsight.sources import event_log, history_dump, sinks
from jobsight.streaming import feeds

_STARTED = "NOT (status = 'failed' AND priority = 'cost')"
_LOG_SUMS = """
SELECT app_key, COUNT(*) AS total_tasks, COUNT(*) FILTER (failed_tasks > 0) AS failed_tasks,
  CAST(SUM(input_bytes) AS BIGINT) AS input_bytes, CAST(SUM(output_bytes) AS BIGINT) AS output_bytes,
  CAST(SUM(shuffle_read_bytes) AS BIGINT) AS shuffle_read_bytes,
  CAST(SUM(shuffle_write_bytes) AS BIGINT) AS shuffle_write_bytes,
  CAST(SUM(memory_spilled_bytes) AS BIGINT) AS memory_spilled_bytes,
  CAST(SUM(disk_spilled_bytes) AS BIGINT) AS disk_spilled_bytes, CAST(SUM(run_ms) AS BIGINT) AS executor_run_time_ms,
  CAST(SUM(cpu_ms) AS BIGINT) AS executor_cpu_time_ms, CAST(SUM(gc_ms) AS BIGINT) AS jvm_gc_time_ms,
  MAX(peak_memory) AS peak_memory_usage, COUNT(DISTINCT stage_id) AS total_stages
FROM task_events GROUP BY app_key"""
_SUMS = [
    "total_tasks", "failed_tasks", "input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
    "memory_spilled_bytes", "disk_spilled_bytes", "executor_run_time_ms", "executor_cpu_time_ms", "jvm_gc_time_ms",
    "peak_memory_usage",
]


def from_log(name: str, sql: str | None):
    return query(name, sql, {"log_sums": _LOG_SUMS})


@from_log(
    "src_01_log_scan",
    """SELECT 'SparkListenerApplicationStart' AS event, COUNT(*) AS lines FROM order_info
      WHERE NOT (status = 'failed' AND priority = 'cost')
    UNION ALL SELECT 'SparkListenerApplicationEnd', COUNT(*) FROM order_info WHERE status <> 'running'
    UNION ALL SELECT 'SparkListenerEnvironmentUpdate', COUNT(*) FROM order_info
    UNION ALL SELECT 'SparkListenerTaskEnd', (SELECT COUNT(*) FROM task_events) + COUNT(*) FILTER (status = 'failed')
      FROM order_info
    UNION ALL SELECT 'SparkListenerStageCompleted', COUNT(*) FROM task_events""",
)
def _(t):
    """The rendered logs written as one rolling, compressed log and scanned back."""
    folder = shared_dir(t.spark, "logs")
    landed.log_lines(t).select("line").write.text(f"{folder}/eventlog_v2_fleet", compression="gzip")
    lines = event_log.read_lines(t.spark, folder)
    event = F.regexp_extract("line", r'"Event"\s*:\s*"([A-Za-z]+)"', 1).alias("event")
    return lines.groupBy("log", event).agg(F.count(F.lit(1)).alias("lines")).drop("log")


@from_log(
    "src_02_rejected_lines",
    "SELECT 'file:/logs/' || app_id || '.log' AS log, CAST(1 AS BIGINT) AS rejected FROM order_info WHERE status = 'failed'",
)
def _(t):
    broken = event_log.rejects(landed.log_lines(t))
    return broken.groupBy("log").agg(F.count(F.lit(1)).alias("rejected"))


@from_log(
    "src_02_decoded_events",
    f"""SELECT app_id, CAST({_STARTED} AS BIGINT) + CAST(status <> 'running' AS BIGINT) + 1
      + 2 * coalesce(total_tasks, 0) AS events FROM order_info LEFT JOIN log_sums USING (app_key)""",
)
def _(t):
    events = event_log.decode(landed.log_lines(t)).groupBy("log").agg(F.count(F.lit(1)).alias("events"))
    return events.select(F.regexp_extract("log", r"(app-\d+)", 1).alias("app_id"), "events")


@from_log(
    "src_03_first_events",
    f"""SELECT app_id, app_name, user_name, start_ms, CASE WHEN status <> 'running' THEN duration_ms END AS duration_ms
    FROM order_info WHERE {_STARTED}""",
)
def _(t):
    apps = event_log.applications(landed.log_lines(t))
    return apps.select("app_id", "app_name", "user_name", F.unix_millis("start_time").alias("start_ms"), "duration_ms")


@from_log(
    "src_04_task_roll_up",
    f"SELECT app_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _SUMS)} FROM order_info LEFT JOIN log_sums USING (app_key)"
    f" WHERE {_STARTED}",
)
def _(t):
    return event_log.applications(landed.log_lines(t)).select("app_id", *_SUMS)


@from_log(
    "src_05_distinct_stages",
    f"""SELECT app_id, coalesce(total_stages, 0) AS total_stages FROM order_info LEFT JOIN log_sums USING (app_key)
    WHERE {_STARTED}""",
)
def _(t):
    return event_log.applications(landed.log_lines(t)).select("app_id", "total_stages")


@from_log(
    "src_06_application_record",
    f"""SELECT app_id, CASE WHEN status <> 'running' THEN start_ms + duration_ms END AS end_ms,
      CASE WHEN job_type = 'sql' THEN 1 ELSE executor_cores END AS executor_cores, executor_memory_mb, num_executors,
      driver_memory_mb, CAST(1 AS BIGINT) AS driver_cores, coalesce(total_stages, 0) AS total_stages
    FROM order_info LEFT JOIN log_sums USING (app_key) WHERE {_STARTED}""",
)
def _(t):
    sized = ["executor_cores", "executor_memory_mb", "num_executors", "driver_memory_mb", "driver_cores"]
    return event_log.applications(landed.log_lines(t)).select(
        "app_id",
        F.unix_millis("end_time").alias("end_ms"),
        *[F.col(c).cast("long").alias(c) for c in sized],
        "total_stages",
    )


@from_log(
    "snk_06_stage_rows",
    """SELECT app_key, stage_id, COUNT(*) AS num_tasks, 'stage ' || CAST(stage_id AS VARCHAR) AS stage_name,
      CAST(SUM(input_bytes) AS BIGINT) AS input_bytes, CAST(SUM(run_ms) AS BIGINT) AS executor_run_time_ms
    FROM task_events GROUP BY app_key, stage_id""",
)
def _(t):
    stages = event_log.stages(landed.log_lines(t)).filter(F.col("num_tasks") > 0)
    return stages.select(
        F.regexp_extract("log", r"app-(\d+)", 1).cast("long").alias("app_key"),
        F.col("stage_id").cast("long").alias("stage_id"),
        "num_tasks",
        "stage_name",
        "input_bytes",
        "executor_run_time_ms",
    )


def _history(t):
    apps, details, executors, environment = landed.history_payloads(t)
    return (
        history_dump.parse(apps, history_dump.APP_SCHEMA),
        history_dump.parse(details, history_dump.DETAILS_SCHEMA),
        history_dump.parse(executors, history_dump.EXECUTORS_SCHEMA),
        history_dump.parse(environment, history_dump.ENVIRONMENT_SCHEMA),
    )


@query(
    "src_07_history_applications",
    """SELECT app_id, user_name, start_ms, CASE WHEN status <> 'running' THEN start_ms + duration_ms END AS end_ms,
      o.duration_ms, coalesce(s.n, 0) AS num_executors, CASE WHEN job_type = 'sql' THEN 1 ELSE executor_cores END
        AS executor_cores, CASE WHEN job_type = 'sql' THEN 1024 ELSE executor_memory_mb END AS executor_memory_mb,
      CASE WHEN job_type = 'sql' THEN 1024 ELSE driver_memory_mb END AS driver_memory_mb,
      coalesce(t.total_tasks, 0) AS total_tasks, coalesce(t.total_stages, 0) AS total_stages,
      coalesce(t.input_bytes, 0) AS input_bytes, coalesce(t.shuffle_write_bytes, 0) AS shuffle_write_bytes,
      coalesce(t.executor_run_time_ms, 0) AS executor_run_time_ms
    FROM order_info o LEFT JOIN task_sums t USING (app_key)
    LEFT JOIN (SELECT app_key, COUNT(*) AS n FROM stages GROUP BY app_key) s USING (app_key)""",
)
def _(t):
    rows = history_dump.normalise(*_history(t))
    sized = ["num_executors", "executor_cores", "executor_memory_mb", "driver_memory_mb"]
    return rows.select(
        "app_id",
        "user_name",
        F.unix_millis("start_time").alias("start_ms"),
        F.unix_millis("end_time").alias("end_ms"),
        "duration_ms",
        *[F.col(c).cast("long").alias(c) for c in sized],
        "total_tasks",
        "total_stages",
        "input_bytes",
        "shuffle_write_bytes",
        "executor_run_time_ms",
    )


@query(
    "src_08_completed_applications",
    """SELECT app_id FROM order_info WHERE status = 'completed' AND start_ms >= 883612800000""",
)
def _(t):
    apps = _history(t)[0]
    return history_dump.select_applications(apps, "completed", min_start_ms=883612800000).select(F.col("id").alias("app_id"))


# Vendor clusters ---------------------------------------------------------------

_NOW = "2002-01-01"
_NOW_MS = 1009843200000
_NODE_TABLE = "SELECT * FROM (VALUES {}) v(node_type, cores, memory_gb, rate)"


def _node_values(rows):
    return _NODE_TABLE.format(", ".join(f"('{n}', {c}, {m!r}::DOUBLE, {p!r}::DOUBLE)" for n, c, m, p in rows))


CLUSTER_SQL = {
    "step_nodes": _node_values(cat.STEP_NODES),
    "run_nodes": _node_values(cat.RUN_NODES),
    "job_nodes": _node_values(cat.JOB_NODES),
    "base_clusters": f"""
SELECT c_custkey AS k, c_name AS owner, c_nationkey AS n, {landed.BASE_MS} + c_custkey * {landed.HOUR} AS created,
  {landed.BASE_MS} + c_custkey * {landed.HOUR} + (c_custkey % 100 + 1) * {landed.HOUR} AS closed FROM customer""",
    "step_clusters": """
SELECT *, 'j-' || CAST(k AS VARCHAR) AS cluster_id, CASE n % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'WAITING'
    ELSE 'TERMINATED' END AS state,
  CASE k % 5 WHEN 0 THEN 'm5.2xlarge' WHEN 1 THEN 'r5.4xlarge' WHEN 2 THEN 'c5.9xlarge' WHEN 3 THEN 'x1.huge' END
    AS core_type, CASE WHEN k % 5 <> 4 THEN 1 + k % 7 END AS core_count
FROM base_clusters""",
    "step_costs": f"""
SELECT cluster_id, (0.192e0 * 1 + coalesce(rate, 0e0) * coalesce(core_count, 0) + 0.252e0 * (k % 3))
  * ((CASE WHEN state = 'TERMINATED' THEN closed ELSE {_NOW_MS} END - created) / 3600000e0) AS cluster_cost
FROM step_clusters LEFT JOIN step_nodes ON node_type = core_type""",
    "run_clusters": f"""
SELECT *, 'c-' || CAST(k AS VARCHAR) AS cluster_id, {landed.RUN_NODE} AS node_type_id, k % 9 AS num_workers,
  CASE WHEN k % 2 = 0 THEN k % 3 END AS low, CASE WHEN k % 2 = 0 THEN 3 + k % 6 END AS high FROM base_clusters""",
    "job_clusters": f"""
SELECT *, 'dp-' || CAST(k AS VARCHAR) AS cluster_name, {landed.JOB_NODE} AS machine, 2 + k % 5 AS workers,
  CASE n % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'UPDATING' ELSE 'STOPPED' END AS state,
  CASE k % 2 WHEN 0 THEN 'prod' ELSE 'dev' END AS env FROM base_clusters""",
}


def clustered(name: str, sql: str | None):
    return query(name, sql, {**MEASURES, **CLUSTER_SQL})


def _steps(t):
    clusters, steps = landed.step_payloads(t)
    return dumps.parse(steps, dumps.STEP_SCHEMA, "ClusterId"), dumps.parse(clusters, dumps.STEP_CLUSTER_SCHEMA, "Id")


def _runs(t):
    clusters, runs = landed.run_payloads(t)
    return dumps.parse(runs, dumps.RUN_SCHEMA, "run_id"), dumps.parse(clusters, dumps.RUN_CLUSTER_SCHEMA, "cluster_id")


def _jobs(t):
    clusters, found = landed.job_payloads(t)
    return dumps.parse(found, dumps.JOB_SCHEMA, "cluster_name"), dumps.parse(
        clusters, dumps.JOB_CLUSTER_SCHEMA, "cluster_name"
    )


def _long(*names):
    return [F.col(c).cast("long").alias(c) for c in names]


@clustered(
    "src_09_step_applications",
    """SELECT cluster_id || '-s-' || CAST(app_key AS VARCHAR) AS app_id, app_name,
      CASE WHEN n % 2 = 0 THEN owner ELSE 'unknown' END AS user_name,
      CASE WHEN status = 'running' THEN 0 ELSE duration_ms END AS duration_ms,
      coalesce(core_count, 1) AS num_executors,
      CAST(CASE WHEN core_type IS NULL THEN 4 ELSE coalesce(s.cores, 4) END AS BIGINT) AS executor_cores,
      CAST(floor(CASE WHEN core_type IS NULL THEN 16e0 ELSE coalesce(s.memory_gb, 16e0) END * 1024 * 0.9e0) AS BIGINT)
        AS executor_memory_mb, coalesce(core_type, 'm5.xlarge') AS instance_type, upper(status) AS step_state
    FROM order_info o JOIN step_clusters c ON c.k = o.cust_key LEFT JOIN step_nodes s ON s.node_type = core_type
    WHERE NOT (status = 'failed' AND priority = 'cost')""",
)
def _(t):
    rows = dumps.step_applications(*_steps(t))
    return rows.select(
        "app_id", "app_name", "user_name", "duration_ms",
        *_long("num_executors", "executor_cores", "executor_memory_mb"),
        F.col("tags")["instance_type"].alias("instance_type"), F.col("tags")["step_state"].alias("step_state"),
    )


@clustered(
    "src_10_cluster_selection",
    """SELECT cluster_id, state FROM step_clusters WHERE state IN ('RUNNING', 'WAITING') AND created > epoch_ms(TIMESTAMP '1995-01-15')
    ORDER BY created DESC, cluster_id LIMIT 40""",
)
def _(t):
    picked = dumps.select_step_clusters(_steps(t)[1], ["RUNNING", "WAITING"], "1995-01-15", 40)
    return picked.select(F.col("Id").alias("cluster_id"), F.col("Status.State").alias("state"))


@clustered("src_11_step_cluster_cost", f"SELECT cluster_id, {r('cluster_cost', 4)} AS cluster_cost FROM step_costs")
def _(t):
    return dumps.step_cluster_cost(_steps(t)[1], _NOW).withColumn("cluster_cost", half_even("cluster_cost", 4))


@clustered(
    "src_12_cost_split",
    f"""SELECT cluster_id || '-s-' || CAST(app_key AS VARCHAR) AS app_id,
      {r('cluster_cost / COUNT(*) OVER (PARTITION BY cluster_id)', 4)} AS estimated_cost
    FROM order_info o JOIN step_clusters c ON c.k = o.cust_key JOIN step_costs USING (cluster_id)
    WHERE NOT (status = 'failed' AND priority = 'cost')""",
)
def _(t):
    steps, clusters = _steps(t)
    apps = dumps.step_applications(steps, clusters).select("app_id", "cluster_id")
    shared = dumps.split_evenly(apps, dumps.step_cluster_cost(clusters, _NOW), "cluster_id")
    return shared.select("app_id", half_even("estimated_cost", 4).alias("estimated_cost"))


@query(
    "src_13_utilisation",
    f"""SELECT user_id, {r('AVG(mean)', 6)} AS utilisation, COUNT(*) AS datapoints FROM (
      SELECT user_id, us // 300000000 AS w, AVG(value) AS mean, MAX(us) AS last_us, ANY_VALUE(now) AS now
      FROM (SELECT *, MAX(us) OVER (PARTITION BY user_id) AS now FROM points) p GROUP BY user_id, us // 300000000) x
    WHERE last_us >= now - 3600000000::BIGINT GROUP BY user_id""",
)
def _(t):
    out = dumps.utilisation(t.points, "user_id")
    return out.withColumn("utilisation", half_even("utilisation", 6))


@clustered(
    "src_14_run_applications",
    """SELECT cluster_id || '-' || CAST(app_key AS VARCHAR) AS app_id,
      CASE WHEN team <> 'building' THEN user_name ELSE 'unknown' END AS user_name,
      CASE WHEN status = 'running' THEN 0 ELSE duration_ms END AS duration_ms,
      CASE WHEN high IS NOT NULL THEN high ELSE num_workers END AS num_executors,
      CAST(coalesce(s.cores, 4) AS BIGINT) AS executor_cores,
      CAST(floor(coalesce(s.memory_gb, 14e0) * 1024 * 0.9e0) AS BIGINT) AS executor_memory_mb,
      num_executors AS total_tasks, CAST(status = 'failed' AS BIGINT) AS failed_tasks,
      CASE status WHEN 'failed' THEN 'FAILED' WHEN 'completed' THEN 'SUCCESS' ELSE 'UNKNOWN' END AS run_state
    FROM order_info o JOIN run_clusters c ON c.k = o.cust_key LEFT JOIN run_nodes s ON s.node_type = node_type_id""".replace(
        "num_executors AS total_tasks", "o.num_executors AS total_tasks"
    ),
)
def _(t):
    rows = dumps.run_applications(*_runs(t))
    return rows.select(
        "app_id", "user_name", "duration_ms", *_long("num_executors", "executor_cores", "executor_memory_mb"),
        "total_tasks", "failed_tasks", F.col("tags")["run_state"].alias("run_state"),
    )


@clustered(
    "src_15_recent_runs",
    f"SELECT app_key AS run_id FROM order_info WHERE start_ms BETWEEN {_NOW_MS} - 365 * 86400000::BIGINT AND {_NOW_MS}",
)
def _(t):
    return dumps.recent_runs(_runs(t)[0], _NOW_MS, 365).select("run_id")


@clustered(
    "src_16_run_cluster_cost",
    f"""SELECT cluster_id, {r(f'''(CASE WHEN high IS NOT NULL THEN (low + high) / 2e0 ELSE num_workers END + 1)
      * coalesce(rate, 0.75e0) * (({_NOW_MS} - created) / 3600000e0) * 0.4e0''', 4)} AS cluster_cost
    FROM run_clusters LEFT JOIN run_nodes ON node_type = node_type_id""",
)
def _(t):
    costs = dumps.run_cluster_cost(_runs(t)[1], _NOW_MS, 0.4)
    return costs.withColumn("cluster_cost", half_even("cluster_cost", 4))


_JOB_ROWS = """
SELECT o.*, c.cluster_name, machine, workers, c.k, coalesce(s.cores, 4) AS cores, coalesce(s.memory_gb, 15e0) AS memory_gb,
  coalesce(s.rate, 0.19e0) AS rate, CASE WHEN status = 'running' THEN 0 ELSE o.duration_ms END AS took
FROM order_info o JOIN job_clusters c ON c.k = o.cust_key LEFT JOIN job_nodes s ON s.node_type = machine"""


@query(
    "src_17_job_applications",
    """SELECT cluster_name || '-' || app_id AS app_id, app_id AS app_name, user_name, took AS duration_ms,
      workers AS num_executors, CAST(cores AS BIGINT) AS executor_cores,
      CAST(floor(memory_gb * 1024) AS BIGINT) AS executor_memory_mb, CAST(status = 'failed' AS BIGINT) AS failed_tasks,
      CAST(status = 'completed' AS BIGINT) AS succeeded_tasks,
      CASE job_type WHEN 'ml' THEN 'pyspark' WHEN 'sql' THEN 'spark_sql' WHEN 'streaming' THEN 'unknown' ELSE 'spark' END
        AS kind FROM job_rows""",
    {**CLUSTER_SQL, "job_rows": _JOB_ROWS},
)
def _(t):
    rows = dumps.job_applications(*_jobs(t))
    return rows.select(
        "app_id", "app_name", "user_name", "duration_ms",
        *_long("num_executors", "executor_cores", "executor_memory_mb"),
        "failed_tasks", "succeeded_tasks", F.col("tags")["job_type"].alias("kind"),
    )


@query(
    "src_18_job_cost",
    f"""SELECT cluster_name || '-' || app_id AS app_id, CASE WHEN took = 0 THEN 0e0 ELSE
      {r('''1 * 0.19e0 * h + workers * rate * h + CASE WHEN k % 3 = 0 THEN 2 * 0.13e0 * h * 0.8e0 ELSE 0e0 END''', 4)} END
      AS estimated_cost FROM (SELECT *, took / 1000e0 / 3600e0 AS h FROM job_rows) x""",
    {**CLUSTER_SQL, "job_rows": _JOB_ROWS},
)
def _(t):
    return dumps.job_applications(*_jobs(t)).select("app_id", "estimated_cost")


@clustered(
    "src_19_live_clusters",
    "SELECT cluster_name, state FROM job_clusters WHERE state IN ('RUNNING', 'UPDATING') AND env = 'prod'",
)
def _(t):
    live = dumps.select_job_clusters(_jobs(t)[1], labels={"env": "prod"})
    return live.select("cluster_name", "state")


@clustered(
    "src_19_jobs_in_range",
    """SELECT app_id FROM order_info WHERE CASE WHEN status = 'running' THEN start_ms ELSE start_ms + duration_ms END
      BETWEEN 883612800000 AND 915148800000""",
)
def _(t):
    found = dumps.jobs_between(_jobs(t)[0], 883612800000, 915148800000)
    return found.select(F.col("reference.job_id").alias("app_id"))


_PERCENT = """
SELECT *, CASE WHEN executor_run_time_ms > 0 THEN CAST(executor_cpu_time_ms AS DOUBLE) / executor_run_time_ms * 100
    ELSE 0e0 END AS cpu_percent, least(1e0, mem_share) * 100 AS memory_percent,
  CASE executor_cores WHEN 1 THEN 'm5.xlarge' WHEN 2 THEN 'c5.4xlarge' WHEN 4 THEN 'r5.2xlarge' ELSE 'other' END AS step_node,
  CASE executor_cores WHEN 1 THEN 'Standard_F16s' WHEN 2 THEN 'i3.4xlarge' WHEN 4 THEN 'r5d.xlarge' ELSE 'other' END AS run_node,
  CASE executor_cores WHEN 1 THEN 'n1-highmem-8' WHEN 2 THEN 'n1-standard-16' WHEN 4 THEN 'c2-standard-4'
    ELSE 'n1-standard-32' END AS job_node
FROM measures"""


def _profiles(t):
    """Runs with their utilisation and the node types they are said to run on."""
    pick = lambda a, b, c, d: F.expr(
        f"CASE executor_cores WHEN 1 THEN '{a}' WHEN 2 THEN '{b}' WHEN 4 THEN '{c}' ELSE '{d}' END"
    )
    allocated = F.col("executor_memory_mb").cast("long") * MIB * F.col("num_executors")
    return jobs(t).withColumns(
        {
            "cpu_percent": ratio("executor_cpu_time_ms", "executor_run_time_ms") * 100,
            "memory_percent": F.least(F.lit(1.0), ratio("peak_memory_usage", allocated)) * 100,
            "step_node": pick("m5.xlarge", "c5.4xlarge", "r5.2xlarge", "other"),
            "run_node": pick("Standard_F16s", "i3.4xlarge", "r5d.xlarge", "other"),
            "job_node": pick("n1-highmem-8", "n1-standard-16", "c2-standard-4", "n1-standard-32"),
        }
    )


def _advice_sql(nodes, current, best, extra=""):
    return f"""SELECT app_id, current_type, recommended_type,
      {r('CASE WHEN coalesce(a.rate, 0e0) > 0 THEN (coalesce(b.rate, 0e0) - a.rate) / a.rate * 100 ELSE 0e0 END', 2)}
        AS cost_change_percent{extra}
    FROM (SELECT *, {current} AS current_type, {best} AS recommended_type FROM profiles) p
    LEFT JOIN {nodes} a ON a.node_type = current_type LEFT JOIN {nodes} b ON b.node_type = recommended_type"""


def advised(name, sql):
    return query(name, sql, {**MEASURES, **CLUSTER_SQL, "profiles": _PERCENT})


@advised(
    "src_20_step_node_advice",
    _advice_sql(
        "step_nodes",
        "step_node",
        "CASE WHEN memory_percent > 70 OR job_type = 'ml' THEN 'r5.4xlarge' WHEN cpu_percent > 70 THEN 'c5.4xlarge'"
        " ELSE 'm5.4xlarge' END",
    ),
)
def _(t):
    c = F.col
    out = dumps.step_node_advice(_profiles(t), c("step_node"), c("cpu_percent"), c("memory_percent"), c("job_type"))
    return out.drop("reason")


@advised(
    "src_21_run_node_advice",
    _advice_sql(
        "run_nodes",
        "run_node",
        """CASE WHEN memory_percent > 70 OR job_type = 'ml' THEN CASE WHEN run_node LIKE 'Standard%' THEN 'Standard_E8s_v3'
             ELSE 'r5d.2xlarge' END
           WHEN rate > 1000 OR job_type = 'streaming' THEN CASE WHEN run_node LIKE 'Standard%' THEN 'Standard_DS4_v2'
             ELSE 'i3.2xlarge' END
           WHEN job_type = 'sql' THEN CASE WHEN run_node LIKE 'Standard%' THEN 'Standard_F8s' ELSE 'i3.xlarge' END
           WHEN run_node LIKE 'Standard%' THEN 'Standard_DS4_v2' ELSE 'i3.2xlarge' END""",
        ", job_type IN ('etl', 'streaming') AS autoscaling_recommended",
    ),
)
def _(t):
    c = F.col
    io_heavy = ratio(c("input_bytes") + c("output_bytes"), "duration_ms") > 1000
    return dumps.run_node_advice(_profiles(t), c("run_node"), c("memory_percent") > 70, io_heavy, c("job_type"))


@advised(
    "src_22_job_node_advice",
    _advice_sql(
        "job_nodes",
        "job_node",
        """CASE WHEN memory_percent > 70 OR job_type = 'ml' THEN CASE executor_cores WHEN 1 THEN job_node
             WHEN 4 THEN 'n2-highmem-8' ELSE 'n2-highmem-16' END
           WHEN cpu_percent > 95 OR job_type = 'streaming' THEN CASE executor_cores WHEN 4 THEN job_node
             WHEN 1 THEN 'c2-standard-8' ELSE 'c2-standard-16' END
           WHEN priority = 'cost' OR job_type = 'batch' THEN CASE WHEN executor_cores IN (1, 4) THEN 'e2-standard-8'
             ELSE 'e2-standard-16' END
           WHEN executor_cores IN (1, 4) THEN 'n2-standard-8' WHEN executor_cores = 2 THEN 'n2-standard-16'
           ELSE 'n2-standard-32' END""",
        ", job_type IN ('batch', 'etl') OR priority = 'cost' AS preemptible_recommended",
    ),
)
def _(t):
    c = F.col
    return dumps.job_node_advice(
        _profiles(t), c("job_node"), c("memory_percent") > 70, c("cpu_percent") > 95, c("priority") == "cost", c("job_type")
    )


@clustered(
    "src_23_catalog_coverage",
    """SELECT node_type, CAST(COUNT(k) AS BIGINT) AS clusters, CAST(SUM(core_count * cores) AS BIGINT) AS total_cores
    FROM step_nodes JOIN step_clusters ON core_type = node_type GROUP BY node_type""",
)
def _(t):
    """Catalog rows in use by clusters, with the cores they add up to."""
    groups = _steps(t)[1].select(F.inline("InstanceGroups")).filter(F.col("InstanceGroupType") == "CORE")
    joined = groups.join(
        F.broadcast(cat.nodes(t.spark, cat.STEP_NODES)), groups["InstanceType"] == F.col("node_type")
    )
    return joined.groupBy("node_type").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum(F.col("RequestedInstanceCount") * F.col("cores")).alias("total_cores")
    )


# Sinks -----------------------------------------------------------------------


def _incoming(t):
    """Everything once, finished runs a second time, and one row without an id per failed run."""
    o = t.orders.select("app_id", "app_name", "status", "start_time", "duration_ms", "executor_cores", "num_executors")
    again = o.filter(F.col("status") == "completed")
    lost = o.filter(F.col("status") == "failed").withColumn("app_id", F.lit(None).cast("string"))
    return o.unionByName(again).unionByName(lost)


def _existing(t):
    return t.orders.filter(F.col("priority") == "balanced").select("app_id")


@query(
    "snk_01_insert_if_absent",
    """SELECT app_id, CASE WHEN priority = 'balanced' THEN 'skipped' ELSE 'collected' END AS outcome FROM order_info""",
)
def _(t):
    return sinks.classify_new(_incoming(t), _existing(t)).select("app_id", "outcome")


@query(
    "snk_01_insert_counts",
    """SELECT 'collected' AS outcome, COUNT(*) FILTER (priority <> 'balanced') AS rows FROM order_info
    UNION ALL SELECT 'skipped', COUNT(*) FILTER (priority = 'balanced') + COUNT(*) FILTER (status = 'completed') FROM order_info
    UNION ALL SELECT 'failed', COUNT(*) FILTER (status = 'failed') FROM order_info""",
)
def _(t):
    incoming = _incoming(t)
    return sinks.insert_counts(incoming, sinks.classify_new(incoming, _existing(t)))


@query(
    "snk_02_canonical_rows",
    """SELECT app_id, executor_memory_mb, driver_memory_mb, total_tasks, coalesce(failed_tasks, 0) AS failed_tasks, input_bytes
    FROM applications""",
)
def _(t):
    """Nested metrics of zero fall back to the flat ones, memory comes as text; written, then read back."""
    record = t.apps.select(
        "app_id",
        "app_name",
        "start_time",
        F.struct(
            F.when(F.col("status") == "completed", F.col("total_tasks")).otherwise(F.lit(0)).alias("total_tasks"),
            F.col("input_bytes"),
        ).alias("metrics"),
        F.col("total_tasks"),
        F.coalesce("failed_tasks", F.lit(0)).alias("failed_tasks"),
        F.concat(F.col("executor_memory_mb").cast("string"), F.lit("m")).alias("executor_memory"),
        F.concat((F.col("driver_memory_mb") / 1024).cast("int").cast("string"), F.lit("G")).alias("driver_memory"),
    )
    path = shared_dir(t.spark, "store")
    sinks.write_applications(sinks.canonical_jobs(record), path)
    return sinks.read_applications(t.spark, path).select(
        "app_id", *_long("executor_memory_mb", "driver_memory_mb"), "total_tasks", "failed_tasks", "input_bytes"
    )


@query(
    "snk_03_recommendation_rows",
    """SELECT recommendation_id, job_signature, recommended_num_executors, predicted_duration_ms, recommendation_method
    FROM recommendations""",
)
def _(t):
    path = shared_dir(t.spark, "recommendations")
    sinks.write_recommendations(t.recommendations, path)
    return t.spark.read.parquet(path).select(
        "recommendation_id", "job_signature", *_long("recommended_num_executors"), "predicted_duration_ms",
        "recommendation_method",
    )


@query(
    "snk_04_update_by_key",
    """SELECT app_id, CASE WHEN status = 'running' THEN 'completed' ELSE status END AS status,
      CASE WHEN status = 'running' THEN duration_ms + 1 ELSE duration_ms END AS duration_ms, status = 'running' AS touched
    FROM order_info""",
)
def _(t):
    table = t.orders.select("app_id", "status", "duration_ms")
    changes = t.orders.filter(F.col("status") == "running").select(
        "app_id", F.lit("completed").alias("status"), (F.col("duration_ms") + 1).alias("duration_ms"),
        F.lit(1).alias("unknown_field"),
    )
    # Every change comes twice, the older one with another status; the new version is written and read back.
    older = changes.withColumns({"status": F.lit("lost"), "at": F.lit(1)})
    changes = changes.withColumn("at", F.lit(2)).unionByName(older)
    out = sinks.updated(table, changes, "app_id", F.lit("2002-01-01").cast("timestamp"), "at")
    path = sinks.write_version(out, shared_dir(t.spark, "updated"))
    return t.spark.read.parquet(path).withColumn("touched", F.col("updated_at").isNotNull()).drop("updated_at")


@query("snk_05_delete_applications", "SELECT app_id FROM order_info WHERE status <> 'failed'")
def _(t):
    gone = t.orders.filter(F.col("status") == "failed")
    path = sinks.write_version(sinks.without(t.orders.select("app_key", "app_id"), gone, "app_key"), shared_dir(t.spark, "deleted"))
    return t.spark.read.parquet(path).select("app_id")


@query(
    "snk_05_delete_cascade",
    "SELECT app_key, stage_id FROM stages WHERE app_key NOT IN (SELECT app_key FROM order_info WHERE status = 'failed')",
)
def _(t):
    gone = t.orders.filter(F.col("status") == "failed")
    path = sinks.write_version(sinks.without(t.stages.select("app_key", "stage_id"), gone, "app_key"), shared_dir(t.spark, "deleted"))
    return t.spark.read.parquet(path)


@query(
    "snk_07_catalog_export_import",
    """SELECT CAST(p_partkey AS BIGINT) AS line, CASE p_partkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS provider,
      p_retailprice / 1000 AS hourly_price FROM part""",
)
def _(t):
    path = shared_dir(t.spark, "prices")
    sinks.export_json(imported_prices(t), path)
    schema = "line BIGINT, provider STRING, instance_type STRING, vcpus INT, memory_gb DOUBLE, hourly_price DOUBLE"
    return sinks.import_json(t.spark, path, schema).select("line", "provider", "hourly_price")


@query("src_24_live_points", "SELECT event_id, app_id, metric_name, value FROM points")
def _(t):
    """Metric points read as a stream and appended to the store."""
    return feeds.drain(t.streaming("events").points, "points").select("event_id", "app_id", "metric_name", "value")
