"""Landed dumps rendered from the given tables: event-log lines, history payloads and cluster payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.plans.tables import Tables


def _named(**cols: Column) -> Column:
    return F.struct(*[v.alias(k.replace("__", " ")) for k, v in cols.items()])


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def log_lines(t: Tables) -> DataFrame:
    """(log, line): finished runs in the old field names, the others in the current ones; failed runs with a broken line.

    Failed low-cost runs lost their start event.
    """
    log = F.concat(F.lit("file:/logs/"), F.col("app_id"), F.lit(".log")).alias("log")
    orders = t.orders
    old = F.col("status") == "completed"

    def lines(df: DataFrame, *given: tuple[Column, Column]) -> DataFrame:
        """Of every row the lines whose condition holds; the table is read and joined once for all of them."""
        found = [F.struct(wanted.alias("wanted"), F.when(wanted, body).alias("line")) for wanted, body in given]
        return df.select(log, F.inline(F.array(*found))).filter("wanted").select("log", "line")

    always = F.lit(True)
    has_start = ~((F.col("status") == "failed") & (F.col("priority") == "cost"))
    start = F.to_json(
        _named(
            Event=F.lit("SparkListenerApplicationStart"), App__Name=F.col("app_name"), App__ID=F.col("app_id"),
            Timestamp=F.col("start_ms"), User=F.col("user_name"),
        )
    )
    end = F.to_json(_named(Event=F.lit("SparkListenerApplicationEnd"), Timestamp=F.col("start_ms") + F.col("duration_ms")))
    pairs = [
        ("spark.executor.memory", F.concat(F.col("executor_memory_mb").cast("string"), F.lit("m"))),
        ("spark.executor.cores", F.when(F.col("job_type") != "sql", F.col("executor_cores").cast("string"))),
        ("spark.executor.instances", F.col("num_executors").cast("string")),
        ("spark.driver.memory", F.concat((F.col("driver_memory_mb") / 1024).cast("int").cast("string"), F.lit("g"))),
    ]
    entries = F.filter(
        F.array(*[F.array(F.lit(k), v) for k, v in pairs]), lambda p: p[1].isNotNull()
    )
    as_map = F.map_from_entries(F.transform(entries, lambda p: F.struct(p[0], p[1])))
    prefix = '{"Event":"SparkListenerEnvironmentUpdate","Spark Properties":'
    env = F.concat(F.lit(prefix), F.when(old, F.to_json(entries)).otherwise(F.to_json(as_map)), F.lit("}"))
    broken = F.lit('{"Event":"SparkListenerTaskEnd", "Task Info":')
    heads = lines(
        orders,
        (has_start, start),
        (F.col("status") != "running", end),
        (always, env),
        (F.col("status") == "failed", broken),
    )
    tasks = t.tasks.join(orders.select("app_key", "app_id", "status"), "app_key")
    failed = F.col("failed_tasks") > 0
    half = F.floor(F.col("shuffle_read_bytes") / 2).cast("long")
    metrics = _named(
        Executor__Run__Time=F.col("run_ms"),
        Executor__CPU__Time=F.col("cpu_ms") * 1000000,
        JVM__GC__Time=F.col("gc_ms"),
        Peak__Execution__Memory=F.col("peak_memory"),
        Memory__Bytes__Spilled=F.col("memory_spilled_bytes"),
        Disk__Bytes__Spilled=F.col("disk_spilled_bytes"),
        Input__Metrics=_named(Bytes__Read=F.col("input_bytes")),
        Output__Metrics=_named(Bytes__Written=F.col("output_bytes")),
        Shuffle__Read__Metrics=_named(
            Total__Bytes__Read=F.when(old, F.col("shuffle_read_bytes")),
            Remote__Bytes__Read=F.when(~old, half),
            Local__Bytes__Read=F.when(~old, F.col("shuffle_read_bytes") - half),
        ),
        Shuffle__Write__Metrics=_named(
            Bytes__Written=F.when(old, F.col("shuffle_write_bytes")),
            Shuffle__Bytes__Written=F.when(~old, F.col("shuffle_write_bytes")),
        ),
    )
    info = _named(
        Task__ID=F.col("part_key"), Successful=F.when(old, ~failed), Failed=F.when(~old, failed)
    )
    task = F.to_json(
        _named(Event=F.lit("SparkListenerTaskEnd"), Stage__ID=F.col("stage_id"), Task__Info=info, Task__Metrics=metrics)
    )
    stage = F.to_json(
        _named(
            Event=F.lit("SparkListenerStageCompleted"),
            Stage__Info=_named(
                Stage__ID=F.col("stage_id"), Stage__Name=F.concat(F.lit("stage "), F.col("stage_id").cast("string"))
            ),
        )
    )
    return heads.unionByName(lines(tasks, (always, task), (always, stage)))


def _landed(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(F.to_json(_named(**cols)).alias("value"))


def history_payloads(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Application list, details, executors and environment; failed runs carry ISO times only."""
    o = t.orders
    failed = F.col("status") == "failed"
    running = F.col("status") == "running"
    end_ms = F.when(~running, F.col("start_ms") + F.col("duration_ms"))
    first = _named(attemptId=F.lit("1"), sparkUser=F.lit("nobody"), startTimeEpoch=F.lit(0).cast("long"),
                   endTimeEpoch=F.lit(1).cast("long"), startTime=F.lit(None).cast("string"),
                   endTime=F.lit(None).cast("string"), duration=F.lit(1).cast("long"))
    last = _named(
        attemptId=F.lit("2"),
        sparkUser=F.col("user_name"),
        startTimeEpoch=F.when(~failed, F.col("start_ms")),
        endTimeEpoch=F.when(~failed, end_ms),
        startTime=F.when(failed, F.concat(_iso(F.col("start_ms")), F.lit("GMT"))),
        endTime=F.when(failed, F.concat(_iso(end_ms), F.lit("GMT"))),
        duration=F.col("duration_ms"),
    )
    apps = _landed(o, id=F.col("app_id"), name=F.col("app_name"), attempts=F.array(first, last))
    a = t.apps
    details = _landed(
        a,
        id=F.col("app_id"),
        totalTasks=F.col("total_tasks"),
        failedTasks=F.col("failed_tasks"),
        totalStages=F.col("total_stages"),
    )
    worker = _named(
        id=F.col("stage_id").cast("string"),
        totalInputBytes=F.col("input_bytes"),
        totalShuffleRead=F.col("shuffle_read_bytes"),
        totalShuffleWrite=F.col("shuffle_write_bytes"),
        totalDiskBytesSpilled=F.col("disk_spilled_bytes"),
        totalMemoryBytesSpilled=F.col("memory_spilled_bytes"),
        totalDuration=F.col("run_ms"),
    )
    big = F.lit(10**15)
    driver = _named(
        id=F.lit("driver"), totalInputBytes=big, totalShuffleRead=big, totalShuffleWrite=big,
        totalDiskBytesSpilled=big, totalMemoryBytesSpilled=big, totalDuration=big,
    )
    # the executors of one run are few: at most one per stage here
    per_run = (
        t.stages.join(o.select("app_key", "app_id"), "app_key")
        .groupBy("app_id")
        .agg(F.collect_list(worker).alias("workers"))
    )
    executors = _landed(per_run, id=F.col("app_id"), executors=F.array_append("workers", driver))
    props = F.array(
        F.array(F.lit("spark.executor.memory"), F.concat(F.col("executor_memory_mb").cast("string"), F.lit("m"))),
        F.array(F.lit("spark.executor.cores"), F.col("executor_cores").cast("string")),
        F.array(F.lit("spark.driver.memory"), F.concat((F.col("driver_memory_mb") / 1024).cast("int").cast("string"), F.lit("G"))),
    )
    environment = _landed(
        o, id=F.col("app_id"), sparkProperties=F.when(F.col("job_type") != "sql", props)
    )
    return apps, details, executors, environment


BASE_MS = 788918400000  # 1995-01-01
HOUR = 3600000


def _clusters(t: Tables) -> DataFrame:
    return t.raw("customer").select(
        F.col("c_custkey").alias("k"),
        F.col("c_name").alias("owner"),
        F.col("c_nationkey").alias("n"),
        (F.lit(BASE_MS) + F.col("c_custkey") * HOUR).alias("created"),
        (F.lit(BASE_MS) + F.col("c_custkey") * HOUR + (F.col("c_custkey") % 100 + 1) * HOUR).alias("closed"),
    )


def step_payloads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(clusters, steps) of vendor A."""
    c = _clusters(t)
    group = lambda kind, node, n: _named(
        InstanceGroupType=F.lit(kind), InstanceType=node, RequestedInstanceCount=n.cast("int")
    )
    core_type = F.expr("CASE k % 5 WHEN 0 THEN 'm5.2xlarge' WHEN 1 THEN 'r5.4xlarge' WHEN 2 THEN 'c5.9xlarge' ELSE 'x1.huge' END")
    groups = F.array(
        group("MASTER", F.lit("m5.xlarge"), F.lit(1)),
        F.when(F.col("k") % 5 != 4, group("CORE", core_type, 1 + F.col("k") % 7)),
        group("TASK", F.lit("r5.xlarge"), F.col("k") % 3),
    )
    state = F.expr("CASE n % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'WAITING' ELSE 'TERMINATED' END")
    clusters = _landed(
        c,
        Id=F.concat(F.lit("j-"), F.col("k").cast("string")),
        Name=F.concat(F.lit("cluster "), F.col("k").cast("string")),
        ReleaseLabel=F.lit("release-7"),
        Tags=F.when(F.col("n") % 2 == 0, F.create_map(F.lit("Owner"), F.col("owner"))),
        Status=_named(
            State=state,
            Timeline=_named(
                CreationDateTime=_iso(F.col("created")), EndDateTime=F.when(state == "TERMINATED", _iso(F.col("closed")))
            ),
        ),
        InstanceGroups=F.array_compact(groups),
    )
    o = t.orders
    lost = (F.col("status") == "failed") & (F.col("priority") == "cost")
    steps = _landed(
        o,
        ClusterId=F.concat(F.lit("j-"), F.col("cust_key").cast("string")),
        Id=F.concat(F.lit("s-"), F.col("app_key").cast("string")),
        Name=F.col("app_name"),
        Status=_named(
            State=F.upper("status"),
            Timeline=_named(
                CreationDateTime=F.when(~lost, _iso(F.col("start_ms"))),
                EndDateTime=F.when(F.col("status") != "running", _iso(F.col("start_ms") + F.col("duration_ms"))),
            ),
        ),
    )
    return clusters, steps


RUN_NODE = "CASE k % 4 WHEN 0 THEN 'Standard_E8s_v3' WHEN 1 THEN 'i3.xlarge' WHEN 2 THEN 'r5d.4xlarge' ELSE 'unknown' END"


def run_payloads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(clusters, runs) of vendor B."""
    clusters = _landed(
        _clusters(t),
        cluster_id=F.concat(F.lit("c-"), F.col("k").cast("string")),
        cluster_name=F.concat(F.lit("cluster "), F.col("k").cast("string")),
        node_type_id=F.expr(RUN_NODE),
        num_workers=(F.col("k") % 9).cast("int"),
        state=F.lit("RUNNING"),
        start_time=F.col("created"),
        autoscale=F.when(
            F.col("k") % 2 == 0,
            _named(min_workers=(F.col("k") % 3).cast("int"), max_workers=(3 + F.col("k") % 6).cast("int")),
        ),
        spark_version=F.lit("15.x"),
    )
    task = lambda i: _named(task_key=F.concat(F.lit("t"), i.cast("string")))
    runs = _landed(
        t.orders,
        run_id=F.col("app_key"),
        job_id=F.col("cust_key"),
        run_name=F.col("app_name"),
        creator_user_name=F.when(F.col("team") != "building", F.col("user_name")),
        start_time=F.col("start_ms"),
        end_time=F.when(F.col("status") != "running", F.col("start_ms") + F.col("duration_ms")),
        cluster_instance=_named(cluster_id=F.concat(F.lit("c-"), F.col("cust_key").cast("string"))),
        state=_named(result_state=F.when(F.col("status") == "failed", "FAILED").when(F.col("status") == "completed", "SUCCESS")),
        tasks=F.transform(F.sequence(F.lit(1), F.col("num_executors")), task),
    )
    return clusters, runs


JOB_NODE = "CASE k % 4 WHEN 0 THEN 'n1-highmem-8' WHEN 1 THEN 'e2-standard-16' WHEN 2 THEN 'n1-highcpu-4' ELSE 'unknown' END"


def job_payloads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(clusters, jobs) of vendor C; running jobs have no state history yet."""
    node = F.expr(JOB_NODE)
    config = lambda n, kind: _named(num_instances=n.cast("int"), machine_type=kind, disk_size_gb=F.lit(100))
    clusters = _landed(
        _clusters(t),
        cluster_name=F.concat(F.lit("dp-"), F.col("k").cast("string")),
        cluster_uuid=F.concat(F.lit("u-"), F.col("k").cast("string")),
        project_id=F.lit("fleet"),
        region=F.lit("us-central1"),
        state=F.expr("CASE n % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'UPDATING' ELSE 'STOPPED' END"),
        labels=F.create_map(F.lit("env"), F.expr("CASE k % 2 WHEN 0 THEN 'prod' ELSE 'dev' END")),
        master_config=config(F.lit(1), F.lit("n1-standard-4")),
        worker_config=config(2 + F.col("k") % 5, node),
        preemptible_worker_config=F.when(F.col("k") % 3 == 0, config(F.lit(2), F.lit("e2-standard-4"))),
    )
    done = F.when(F.col("status") == "completed", "DONE").when(F.col("status") == "failed", "ERROR").otherwise("RUNNING")
    last = F.when(F.col("status") == "running", F.col("start_ms")).otherwise(F.col("start_ms") + F.col("duration_ms"))
    kind = lambda *types: F.when(F.col("job_type").isin(*types), F.lit("{}"))
    jobs = _landed(
        t.orders,
        cluster_name=F.concat(F.lit("dp-"), F.col("cust_key").cast("string")),
        reference=_named(job_id=F.col("app_id")),
        status=_named(state=done, state_start_time=last, details=F.col("user_name")),
        status_history=F.when(
            F.col("status") != "running",
            F.array(_named(state=F.lit("PENDING"), state_start_time=F.col("start_ms"))),
        ),
        spark_job=kind("etl", "batch"),
        pyspark_job=kind("ml"),
        spark_sql_job=kind("sql"),
    )
    return clusters, jobs
