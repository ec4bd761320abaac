"""Cluster and job dumps of three vendors, landed as JSON, into application rows; cost and node advice.

Node catalogs are code tables, so every lookup is a map inside the row. The
only shuffles are the join of jobs to their cluster and the count per cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even
from jobsight.sources import catalogs as cat

HOUR_MS = 3600000.0

# Field names of the payloads
STEP_CLUSTER_SCHEMA = """
Id STRING, Name STRING, ReleaseLabel STRING, Tags MAP<STRING, STRING>,
Status STRUCT<State: STRING, Timeline: STRUCT<CreationDateTime: STRING, EndDateTime: STRING>>,
InstanceGroups ARRAY<STRUCT<InstanceGroupType: STRING, InstanceType: STRING, RequestedInstanceCount: INT>>"""
STEP_SCHEMA = """
ClusterId STRING, Id STRING, Name STRING,
Status STRUCT<State: STRING, Timeline: STRUCT<CreationDateTime: STRING, EndDateTime: STRING>>"""
RUN_CLUSTER_SCHEMA = """
cluster_id STRING, cluster_name STRING, node_type_id STRING, num_workers INT, state STRING, start_time BIGINT,
autoscale STRUCT<min_workers: INT, max_workers: INT>, spark_version STRING"""
RUN_SCHEMA = """
run_id BIGINT, job_id BIGINT, run_name STRING, creator_user_name STRING, start_time BIGINT, end_time BIGINT,
cluster_instance STRUCT<cluster_id: STRING>, state STRUCT<result_state: STRING>, tasks ARRAY<STRUCT<task_key: STRING>>"""
_GROUP = "STRUCT<num_instances: INT, machine_type: STRING, disk_size_gb: INT>"
JOB_CLUSTER_SCHEMA = f"""
cluster_name STRING, cluster_uuid STRING, project_id STRING, region STRING, state STRING, labels MAP<STRING, STRING>,
master_config {_GROUP}, worker_config {_GROUP}, preemptible_worker_config {_GROUP}"""
JOB_SCHEMA = """
cluster_name STRING, reference STRUCT<job_id: STRING>, status STRUCT<state: STRING, state_start_time: BIGINT, details: STRING>,
status_history ARRAY<STRUCT<state: STRING, state_start_time: BIGINT>>, spark_job STRING, pyspark_job STRING,
spark_sql_job STRING"""


def parse(landed: DataFrame, schema: str, key: str) -> DataFrame:
    return landed.select(F.from_json("value", schema).alias("d")).select("d.*").filter(F.col(key).isNotNull())


def node_field(rows: Sequence[tuple], field: str, node: Column, default: float | None = None) -> Column:
    """cores, memory_gb or rate of a node type."""
    at = cat.NODE_COLUMNS.index(field)
    return cat.lookup({row[0]: float(row[at]) for row in rows}, node, default)


def split_evenly(jobs: DataFrame, costs: DataFrame, cluster: str) -> DataFrame:
    """Cost of a cluster shared by its jobs in equal parts."""
    shares = (
        jobs.groupBy(cluster)
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(costs, cluster)
        .select(cluster, (F.col("cluster_cost") / F.col("_n")).alias("estimated_cost"))
    )
    return jobs.join(shares, cluster, "left").fillna(0.0, ["estimated_cost"])


def utilisation(points: DataFrame, key: str, value: str = "value", period: str = "5 minutes", span: str = "1 hour") -> DataFrame:
    """Mean of the period means over the span before the last point of every key."""
    per_window = points.groupBy(key, F.window("ts", period).alias("w")).agg(
        F.avg(value).alias("mean"), F.max("ts").alias("last_ts")
    )
    last = points.groupBy(key).agg(F.max("ts").alias("now"))
    kept = per_window.join(last, key).filter(F.col("last_ts") >= F.col("now") - F.expr(f"INTERVAL {span}"))
    return kept.groupBy(key).agg(F.avg("mean").alias("utilisation"), F.count(F.lit(1)).alias("datapoints"))


# Vendor A: clusters that run steps --------------------------------------------


def step_applications(steps: DataFrame, clusters: DataFrame) -> DataFrame:
    """Steps with a start time as applications; an executor takes 90 % of a core node (fixed value)."""
    c = clusters.select(F.col("Id").alias("ClusterId"), F.col("Name").alias("cluster_name"), "ReleaseLabel", "Tags", "InstanceGroups")
    core = F.try_element_at(F.filter("InstanceGroups", lambda g: g["InstanceGroupType"] == "CORE"), F.lit(1))
    node = F.coalesce(core["InstanceType"], F.lit("m5.xlarge"))
    start = F.try_to_timestamp(F.col("Status.Timeline.CreationDateTime"))
    end = F.try_to_timestamp(F.col("Status.Timeline.EndDateTime"))
    took = F.coalesce(F.unix_millis(end) - F.unix_millis(start), F.lit(0))
    # A node that is not in the catalog counts as 4 cores and 16 GB, the driver as 4 GB
    return (
        steps.join(c, "ClusterId")
        .filter(start.isNotNull())
        .select(
            F.concat("ClusterId", F.lit("-"), "Id").alias("app_id"),
            F.coalesce("Name", F.lit("Unknown")).alias("app_name"),
            F.coalesce(F.col("Tags")["Owner"], F.lit("unknown")).alias("user_name"),
            start.alias("start_time"),
            end.alias("end_time"),
            took.alias("duration_ms"),
            F.coalesce(core["RequestedInstanceCount"], F.lit(1)).alias("num_executors"),
            node_field(cat.STEP_NODES, "cores", node, 4.0).cast("int").alias("executor_cores"),
            F.floor(node_field(cat.STEP_NODES, "memory_gb", node, 16.0) * 1024 * 0.9).cast("int").alias("executor_memory_mb"),
            F.lit(4096).alias("driver_memory_mb"),
            took.alias("executor_run_time_ms"),
            F.col("ClusterId").alias("cluster_id"),
            F.create_map(
                F.lit("cluster_id"), "ClusterId", F.lit("cluster_name"), "cluster_name", F.lit("instance_type"), node,
                F.lit("release"), "ReleaseLabel", F.lit("step_state"), "Status.State",
            ).alias("tags"),
        )
    )


def select_step_clusters(clusters: DataFrame, states: Sequence[str], created_after: str, limit: int) -> DataFrame:
    created = F.try_to_timestamp(F.col("Status.Timeline.CreationDateTime"))
    wanted = clusters.filter(F.col("Status.State").isin(*states) & (created > F.lit(created_after).cast("timestamp")))
    return wanted.orderBy(created.desc(), "Id").limit(limit)


def step_cluster_cost(clusters: DataFrame, now: str) -> DataFrame:
    """Price x count x hours over the groups of a cluster; an open cluster costs until ``now``."""
    start = F.try_to_timestamp(F.col("Status.Timeline.CreationDateTime"))
    end = F.coalesce(F.try_to_timestamp(F.col("Status.Timeline.EndDateTime")), F.lit(now).cast("timestamp"))
    hours = (F.unix_millis(end) - F.unix_millis(start)) / HOUR_MS
    hourly = F.aggregate(
        "InstanceGroups",
        F.lit(0.0),
        lambda s, g: s
        + node_field(cat.STEP_NODES, "rate", g["InstanceType"], 0.0) * F.coalesce(g["RequestedInstanceCount"], F.lit(0)),
    )
    return clusters.select(
        F.col("Id").alias("cluster_id"), F.coalesce(hourly * hours, F.lit(0.0)).alias("cluster_cost")
    )


def _advice(df: DataFrame, rows: Sequence[tuple], current: Column, recommended: Column, **extra: Column) -> DataFrame:
    now, then = node_field(rows, "rate", current, 0.0), node_field(rows, "rate", recommended, 0.0)
    change = F.when(now > 0, (then - now) / now * 100).otherwise(F.lit(0.0))
    return df.select(
        "app_id",
        current.alias("current_type"),
        recommended.alias("recommended_type"),
        half_even(change, 2).alias("cost_change_percent"),
        *[v.alias(k) for k, v in extra.items()],
    )


def step_node_advice(runs: DataFrame, node: Column, cpu_percent: Column, memory_percent: Column, job_type: Column) -> DataFrame:
    """Memory, compute or general nodes. Limits of 70 % and the three types."""
    memory = (memory_percent > 70) | (job_type == "ml")
    compute = (cpu_percent > 70) | (job_type == "compute")
    best = F.when(memory, "r5.4xlarge").when(compute, "c5.4xlarge").otherwise("m5.4xlarge")
    # reasons
    reason = (
        F.when(memory, "High memory utilization detected - recommending memory-optimized instance")
        .when(compute, "High CPU utilization detected - recommending compute-optimized instance")
        .otherwise("Balanced workload - recommending general purpose instance")
    )
    return _advice(runs, cat.STEP_NODES, node, best, reason=reason)


# Vendor B: clusters that run scheduled runs -----------------------------------


def _workers(autoscaled: Column) -> Column:
    return F.when(F.col("autoscale").isNotNull(), autoscaled).otherwise(F.coalesce("num_workers", F.lit(0)))


def run_applications(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Runs with a start time as applications; an autoscaling cluster counts with its most workers."""
    c = clusters.select(
        "cluster_id", "cluster_name", "node_type_id", "num_workers", "autoscale", F.col("spark_version").alias("runtime")
    )
    node = F.coalesce("node_type_id", F.lit("Standard_DS3_v2"))
    result = F.coalesce("state.result_state", F.lit("UNKNOWN"))
    took = F.coalesce(F.col("end_time") - F.col("start_time"), F.lit(0))
    # An unknown node counts as 4 cores and 14 GB
    return (
        runs.withColumn("cluster_id", F.col("cluster_instance.cluster_id"))
        .join(c, "cluster_id")
        .filter(F.col("start_time").isNotNull())
        .select(
            F.concat("cluster_id", F.lit("-"), F.col("run_id").cast("string")).alias("app_id"),
            F.coalesce("run_name", F.lit("Unknown")).alias("app_name"),
            F.coalesce("creator_user_name", F.lit("unknown")).alias("user_name"),
            F.timestamp_millis("start_time").alias("start_time"),
            F.timestamp_millis("end_time").alias("end_time"),
            took.alias("duration_ms"),
            _workers(F.coalesce("autoscale.max_workers", "num_workers", F.lit(0))).alias("num_executors"),
            node_field(cat.RUN_NODES, "cores", node, 4.0).cast("int").alias("executor_cores"),
            F.floor(node_field(cat.RUN_NODES, "memory_gb", node, 14.0) * 1024 * 0.9).cast("int").alias("executor_memory_mb"),
            F.lit(4096).alias("driver_memory_mb"),
            F.coalesce(F.size("tasks"), F.lit(0)).cast("long").alias("total_tasks"),
            F.when(result == "FAILED", 1).otherwise(0).cast("long").alias("failed_tasks"),
            took.alias("executor_run_time_ms"),
            "cluster_id",
            F.create_map(
                F.lit("cluster_id"), "cluster_id", F.lit("cluster_name"), "cluster_name", F.lit("node_type"), node,
                F.lit("runtime"), "runtime", F.lit("job_id"), F.col("job_id").cast("string"),
                F.lit("run_state"), result,
            ).alias("tags"),
        )
    )


def recent_runs(runs: DataFrame, now_ms: int, days: int) -> DataFrame:
    return runs.filter(F.col("start_time").between(now_ms - days * 86_400_000, now_ms))


def run_cluster_cost(clusters: DataFrame, now_ms: int, unit_price: float) -> DataFrame:
    """(workers + driver) x units per hour x hours x price; autoscaling counts with the mean of min and max."""
    node = F.coalesce("node_type_id", F.lit("Standard_DS3_v2"))
    low = F.coalesce("autoscale.min_workers", F.lit(0))
    high = F.coalesce("autoscale.max_workers", "num_workers", F.lit(0))
    workers = _workers((low + high) / 2.0)
    hours = (F.lit(now_ms) - F.col("start_time")) / HOUR_MS
    units = (workers + 1) * node_field(cat.RUN_NODES, "rate", node, 0.75) * hours
    return clusters.select("cluster_id", F.coalesce(units * F.lit(unit_price), F.lit(0.0)).alias("cluster_cost"))


def run_node_advice(runs: DataFrame, node: Column, memory_heavy: Column, io_heavy: Column, job_type: Column) -> DataFrame:
    """Node type by workload and cloud, and whether to autoscale. The types."""
    azure = node.startswith("Standard_")

    def pick(on_azure: str, elsewhere: str) -> Column:
        return F.when(azure, on_azure).otherwise(elsewhere)

    best = (
        F.when(memory_heavy | (job_type == "ml"), pick("Standard_E8s_v3", "r5d.2xlarge"))
        .when(io_heavy | (job_type == "streaming"), pick("Standard_DS4_v2", "i3.2xlarge"))
        .when(job_type == "sql", pick("Standard_F8s", "i3.xlarge"))
        .otherwise(pick("Standard_DS4_v2", "i3.2xlarge"))
    )
    return _advice(runs, cat.RUN_NODES, node, best, autoscaling_recommended=job_type.isin("etl", "streaming"))


# Vendor C: clusters that run jobs ----------------------------------------------

# Final states, and what an unknown machine counts as
FINAL_STATES = ["DONE", "ERROR", "CANCELLED"]
DEFAULT_MACHINE, DEFAULT_MACHINE_PRICE, PREEMPTIBLE_FACTOR = "n1-standard-4", 0.19, 0.8


def job_times() -> tuple[Column, Column]:
    """Start and end in ms: the first state of the history if the dump has one, and the time of a final state."""
    history_start = F.array_min(F.transform("status_history", lambda h: h["state_start_time"]))
    state_at = F.col("status.state_start_time")
    end = F.when(F.col("status.state").isin(*FINAL_STATES), state_at)
    return F.coalesce(F.least(history_start, state_at), state_at), end


def job_applications(jobs: DataFrame, clusters: DataFrame) -> DataFrame:
    c = clusters.select(
        "cluster_name", "cluster_uuid", "project_id", "region", "master_config", "worker_config", "preemptible_worker_config"
    )
    node = F.coalesce("worker_config.machine_type", F.lit(DEFAULT_MACHINE))
    start, end = job_times()
    kind = (
        F.when(F.col("spark_job").isNotNull(), "spark")
        .when(F.col("pyspark_job").isNotNull(), "pyspark")
        .when(F.col("spark_sql_job").isNotNull(), "spark_sql")
        .otherwise("unknown")
    )
    memory = F.floor(node_field(cat.JOB_NODES, "memory_gb", node, 15.0) * 1024).cast("int")
    state = F.col("status.state")
    rows = jobs.join(c, "cluster_name").withColumn("duration_ms", F.coalesce(end - start, F.lit(0)))
    return rows.select(
        F.concat("cluster_name", F.lit("-"), "reference.job_id").alias("app_id"),
        F.col("reference.job_id").alias("app_name"),
        F.coalesce("status.details", F.lit("unknown")).alias("user_name"),
        F.timestamp_millis(start).alias("start_time"),
        F.timestamp_millis(end).alias("end_time"),
        "duration_ms",
        F.coalesce("worker_config.num_instances", F.lit(2)).alias("num_executors"),
        node_field(cat.JOB_NODES, "cores", node, 4.0).cast("int").alias("executor_cores"),
        memory.alias("executor_memory_mb"),
        memory.alias("driver_memory_mb"),
        F.when(state == "ERROR", 1).otherwise(0).cast("long").alias("failed_tasks"),
        F.when(state == "DONE", 1).otherwise(0).cast("long").alias("succeeded_tasks"),
        job_cost(F.col("duration_ms")).alias("estimated_cost"),
        F.create_map(
            F.lit("cluster_name"), "cluster_name", F.lit("machine_type"), node, F.lit("job_type"), kind,
            F.lit("job_state"), state, F.lit("region"), "region",
        ).alias("tags"),
    )


def job_cost(duration_ms: Column, include_preemptible: bool = True, preemptible_factor: float = PREEMPTIBLE_FACTOR) -> Column:
    """Master, workers and discounted preemptible workers for the duration, four places."""
    hours = duration_ms / 1000.0 / 3600.0

    def part(group: str, default_count: int) -> Column:
        node = F.coalesce(F.col(f"{group}.machine_type"), F.lit(DEFAULT_MACHINE))
        count = F.coalesce(F.col(f"{group}.num_instances"), F.lit(default_count))
        return count * node_field(cat.JOB_NODES, "rate", node, DEFAULT_MACHINE_PRICE) * hours

    total = part("master_config", 1) + part("worker_config", 2)
    if include_preemptible:
        extra = part("preemptible_worker_config", 0) * F.lit(preemptible_factor)
        total = total + F.when(F.col("preemptible_worker_config").isNotNull(), extra).otherwise(F.lit(0.0))
    return F.when(duration_ms == 0, F.lit(0.0)).otherwise(half_even(total, 4))


def select_job_clusters(clusters: DataFrame, names: Sequence[str] = (), labels: dict[str, str] | None = None) -> DataFrame:
    """Live clusters, by name and label if given."""
    wanted = F.col("state").isin("RUNNING", "UPDATING")
    if names:
        wanted = wanted & F.col("cluster_name").isin(*names)
    for k, v in (labels or {}).items():
        wanted = wanted & (F.col("labels")[k] == v)
    return clusters.filter(wanted)


def jobs_between(jobs: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    return jobs.filter(F.col("status.state_start_time").between(from_ms, to_ms))


def job_node_advice(
    runs: DataFrame, node: Column, memory_heavy: Column, compute_heavy: Column, cost_first: Column, job_type: Column
) -> DataFrame:
    """Machine family by workload, size by the cores in use, and whether preemptible workers fit."""
    cores = node_field(cat.JOB_NODES, "cores", node, 4.0)

    def sized(family: str, largest: int) -> Column:
        return (
            F.when(cores <= 8, f"{family}-8").when(cores <= 16, f"{family}-16").otherwise(f"{family}-{largest}")
        )

    def unless(already: Column, target: Column) -> Column:
        return F.when(already, node).otherwise(target)

    # Families per workload
    best = (
        F.when(memory_heavy | (job_type == "ml"), unless(node.contains("highmem"), sized("n2-highmem", 16)))
        .when(
            compute_heavy | job_type.isin("streaming", "realtime"),
            unless(node.startswith("c2-"), sized("c2-standard", 16)),
        )
        .when(cost_first | (job_type == "batch"), unless(node.startswith("e2-"), sized("e2-standard", 16)))
        .when(job_type.isin("etl", "sql"), unless(node.startswith("n2-"), sized("n2-standard", 32)))
        .otherwise(node)
    )
    return _advice(
        runs, cat.JOB_NODES, node, best, preemptible_recommended=job_type.isin("batch", "etl") | cost_first
    )
