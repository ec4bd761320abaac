"""Job telemetry read out of the given star-schema tables.

One order plays one application, one line item one task group, one customer
one cluster or one recommendation request, and one event one metric point.
All of it is whole-number arithmetic, so that another engine can repeat it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.session import prepare
from jobsight.streaming.feeds import stream_files

TASK_SUMS = [
    "num_tasks", "failed_tasks", "input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
    "memory_spilled_bytes", "disk_spilled_bytes", "run_ms", "cpu_ms", "gc_ms",
]

TASK_EVENTS_SQL = """
SELECT app_key, stage_id, supp_key, part_key, ship_ms, quantity AS num_tasks,
  ec*mult AS input_bytes, ec*(mult DIV 2) AS output_bytes,
  ec*(mult DIV 8)*disc AS shuffle_read_bytes, ec*mult*tax AS shuffle_write_bytes,
  CASE WHEN flag='R' THEN ec*(mult DIV 8)*disc ELSE 0 END AS memory_spilled_bytes,
  CASE WHEN flag='R' AND line='F' THEN ec*(mult DIV 16)*disc ELSE 0 END AS disk_spilled_bytes,
  quantity*1000 AS run_ms, quantity*(100-10*tax)*10 AS cpu_ms, quantity*20*disc AS gc_ms,
  ec*256 AS peak_memory,
  CASE WHEN flag='A' AND line='O' AND disc>=9 THEN quantity ELSE 0 END AS failed_tasks,
  disc, tax
FROM (SELECT l_orderkey AS app_key, CAST(l_linenumber AS BIGINT) AS stage_id, l_suppkey AS supp_key,
        l_partkey AS part_key, {ship_ms} AS ship_ms, CAST(l_quantity AS BIGINT) AS quantity,
        CAST(ROUND(l_extendedprice*100) AS BIGINT) AS ec, CAST(ROUND(l_discount*100) AS BIGINT) AS disc,
        CAST(ROUND(l_tax*100) AS BIGINT) AS tax, l_returnflag AS flag, l_linestatus AS line,
        CAST(CASE l_orderkey % 10 WHEN 0 THEN 16384 WHEN 1 THEN 2048 ELSE 64 END AS BIGINT) AS mult
      FROM {lineitem}) x"""


class Tables:
    """Lazy views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, streamed: tuple[str, ...] = (), landed: str | None = None):
        prepare(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.streamed = streamed
        self.landed = landed

    def streaming(self, *names: str, landed: str | None = None) -> Tables:
        """The same views with the named tables read as streams, of their own file or of a folder where rows land."""
        return Tables(self.spark, self.sf_dir, names, landed)

    def raw(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in self.streamed and self.landed is not None:
            return stream_files(self.spark, self.landed, table.schema)
        if name in self.streamed:
            return stream_files(self.spark, self.sf_dir, table.schema, f"{name}.parquet")
        return table

    @cached_property
    def tasks(self) -> DataFrame:
        sql = TASK_EVENTS_SQL.format(lineitem="{lineitem}", ship_ms="unix_millis(CAST(l_shipdate AS TIMESTAMP))")
        return self.spark.sql(sql, lineitem=self.raw("lineitem"))

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with their customer: everything of an application but its task sums."""
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_orderkey").alias("app_key"),
                F.concat(F.lit("app-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("app_id"),
                F.concat(F.lower("c_mktsegment"), F.lit("-"), F.lower(F.expr("substr(o_orderpriority, 3)"))).alias(
                    "app_name"
                ),
                F.col("c_name").alias("user_name"),
                F.col("o_custkey").alias("cust_key"),
                F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END").alias(
                    "status"
                ),
                F.col("o_orderdate").cast("timestamp").alias("start_time"),
                F.expr("CAST(ROUND(o_totalprice*100) AS BIGINT)").alias("duration_ms"),
                F.expr("CASE o_custkey % 3 WHEN 0 THEN '3.4.1' WHEN 1 THEN '3.5.0' ELSE '4.0.0' END").alias(
                    "spark_version"
                ),
                F.expr("CAST(1 + o_orderkey % 20 AS INT)").alias("num_executors"),
                F.expr("CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END").alias(
                    "executor_cores"
                ),
                F.expr(
                    "CASE o_orderkey % 5 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4096 WHEN 3 THEN 8192"
                    " ELSE 16384 END"
                ).alias("executor_memory_mb"),
                F.expr("CASE o_custkey % 2 WHEN 0 THEN 2048 ELSE 4096 END").alias("driver_memory_mb"),
                F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END").alias("provider"),
                F.expr(
                    "CASE o_custkey % 5 WHEN 0 THEN 'etl' WHEN 1 THEN 'ml' WHEN 2 THEN 'streaming'"
                    " WHEN 3 THEN 'batch' ELSE 'sql' END"
                ).alias("job_type"),
                F.expr(
                    "CASE o_orderkey % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'cost' ELSE 'balanced' END"
                ).alias("priority"),
                F.expr("CASE c_nationkey % 2 WHEN 0 THEN 'shared' ELSE 'dedicated' END").alias("cluster_type"),
                F.expr("CASE WHEN o_orderstatus = 'P' THEN 1L ELSE 0L END").alias("failed_stages"),
                F.lower("c_mktsegment").alias("team"),
            )
            .withColumn("start_ms", F.unix_millis("start_time"))
            .withColumn("submit_time", F.col("start_time"))
            .withColumn(
                "end_time",
                F.when(F.col("status") != "running", F.timestamp_millis(F.col("start_ms") + F.col("duration_ms"))),
            )
            .withColumn("tags", F.create_map(F.lit("job_type"), "job_type", F.lit("team"), "team"))
        )

    @cached_property
    def task_sums(self) -> DataFrame:
        return self.tasks.groupBy("app_key").agg(
            *[F.sum(c).cast("long").alias(c) for c in TASK_SUMS],
            F.max("peak_memory").alias("peak_memory_usage"),
            F.count_distinct("stage_id").alias("total_stages"),
        )

    @cached_property
    def apps(self) -> DataFrame:
        """The wide application table. A run that has not failed a task yet reports null, not zero, while running."""
        j = self.orders.join(self.task_sums, "app_key")
        return j.withColumnsRenamed(
            {
                "num_tasks": "total_tasks",
                "run_ms": "executor_run_time_ms",
                "cpu_ms": "executor_cpu_time_ms",
                "gc_ms": "jvm_gc_time_ms",
            }
        ).withColumn(
            "failed_tasks",
            F.when(F.col("status") == "running", F.nullif(F.col("failed_tasks"), F.lit(0).cast("long"))).otherwise(
                F.col("failed_tasks")
            ),
        )

    @cached_property
    def stages(self) -> DataFrame:
        return (
            self.tasks.groupBy("app_key", "stage_id")
            .agg(*[F.sum(c).cast("long").alias(c) for c in TASK_SUMS])
            .withColumn("duration_ms", F.col("run_ms"))
            .withColumn("stage_name", F.concat(F.lit("stage "), F.col("stage_id").cast("string")))
        )

    @cached_property
    def points(self) -> DataFrame:
        """Metric points; three applications share the whole stream, so every key is hot."""
        return self.raw("events").select(
            "event_id",
            F.concat(F.lit("app-"), (F.col("user_id") % 3).cast("string")).alias("app_id"),
            F.col("user_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.expr(
                "CASE event_type WHEN 'click' THEN 'jvm_gc_time_percent' WHEN 'error' THEN 'task_failure_rate'"
                " WHEN 'purchase' THEN 'memory_spill_ratio' WHEN 'view' THEN 'cpu_utilization'"
                " ELSE 'executors_lost' END"
            ).alias("metric_name"),
            F.expr(
                "CASE event_type WHEN 'error' THEN value / 1000 WHEN 'purchase' THEN value / 500"
                " WHEN 'signup' THEN floor(value / 200) ELSE value END"
            )
            .cast("double")
            .alias("value"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """One line item is one observation of a tuning change."""
        return self.tasks.select(
            (F.col("app_key") * 100 + F.col("stage_id")).alias("session_id"),
            F.col("supp_key").alias("app_key"),
            F.col("ship_ms").alias("ts_ms"),
            F.expr(
                "CASE part_key % 5 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4096 WHEN 3 THEN 8192 ELSE 16384 END"
            ).alias("executor_memory"),
            F.expr("CASE supp_key % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END").alias("executor_cores"),
            F.expr("CASE WHEN tax % 3 = 2 THEN 'throughput' WHEN tax % 3 = 1 THEN 'cost' ELSE 'duration' END").alias(
                "metric_name"
            ),
            F.col("run_ms").alias("metric_before"),
            (F.col("cpu_ms") + F.col("gc_ms") * 5).alias("metric_after"),
            (F.col("disc") * 2).alias("expected_improvement"),
            F.col("part_key"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """One customer asks for the configuration of one new run."""
        return self.raw("customer").select(
            F.col("c_custkey").alias("request_id"),
            F.expr(
                "abs(CAST(ROUND(c_acctbal*100) AS BIGINT))"
                " * CASE c_custkey % 10 WHEN 0 THEN 1048576 WHEN 1 THEN 131072 ELSE 4096 END"
            )
            .cast("long")
            .alias("input_bytes"),
            F.expr(
                "CASE c_custkey % 5 WHEN 0 THEN 'etl' WHEN 1 THEN 'ml' WHEN 2 THEN 'streaming'"
                " WHEN 3 THEN 'batch' ELSE NULL END"
            ).alias("job_type"),
            F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'cost' ELSE 'balanced' END").alias(
                "priority"
            ),
            F.expr("CASE WHEN c_custkey % 2 = 0 THEN 30 END").alias("sla_minutes"),
            F.expr("CASE WHEN c_custkey % 7 < 4 THEN 5.0D END").alias("budget_dollars"),
            F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END").alias("provider"),
        )

    @cached_property
    def recommendations(self) -> DataFrame:
        """Advice given for the finished runs, some of it rated by its reader."""
        a = self.orders
        size = F.col("app_key") % 40 * F.lit(1073741824)
        return a.select(
            F.col("app_key").alias("recommendation_id"),
            size.alias("input_size_bytes"),
            F.col("job_type"),
            F.md5(
                F.format_string('{"input_size": %d, "job_type": "%s"}', size, F.col("job_type")).cast("binary")
            ).alias("job_signature"),
            F.col("executor_cores").alias("recommended_executor_cores"),
            F.col("executor_memory_mb").alias("recommended_executor_memory_mb"),
            F.col("num_executors").alias("recommended_num_executors"),
            F.col("driver_memory_mb").alias("recommended_driver_memory_mb"),
            F.col("duration_ms").alias("predicted_duration_ms"),
            F.expr("CASE priority WHEN 'balanced' THEN 'similarity' WHEN 'cost' THEN 'rule_based' ELSE 'ml' END").alias(
                "recommendation_method"
            ),
            F.col("start_ms").alias("created_ms"),
            F.when(F.col("status") != "running", F.col("start_ms") + 60000).alias("used_ms"),
            F.when(F.col("status") == "completed", F.col("duration_ms") % 101).alias("feedback_percent"),
        )


# The same tables for the SQL side.
ORACLE_TABLES = {
    "task_events": TASK_EVENTS_SQL.format(lineitem="lineitem", ship_ms="epoch_ms(l_shipdate)").replace(" DIV ", " // "),
    "order_info": """
SELECT o_orderkey AS app_key, 'app-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS app_id,
  lower(c_mktsegment) || '-' || lower(substr(o_orderpriority, 3)) AS app_name, c_name AS user_name,
  o_custkey AS cust_key,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  epoch_ms(o_orderdate) AS start_ms, CAST(ROUND(o_totalprice*100) AS BIGINT) AS duration_ms,
  CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + CAST(ROUND(o_totalprice*100) AS BIGINT) END AS end_ms,
  strftime(o_orderdate, '%Y-%m-%d') AS start_day,
  CASE o_custkey % 3 WHEN 0 THEN '3.4.1' WHEN 1 THEN '3.5.0' ELSE '4.0.0' END AS spark_version,
  CAST(1 + o_orderkey % 20 AS BIGINT) AS num_executors,
  CAST(CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS BIGINT) AS executor_cores,
  CAST(CASE o_orderkey % 5 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4096 WHEN 3 THEN 8192 ELSE 16384 END
    AS BIGINT) AS executor_memory_mb,
  CAST(CASE o_custkey % 2 WHEN 0 THEN 2048 ELSE 4096 END AS BIGINT) AS driver_memory_mb,
  CASE c_nationkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS provider,
  CASE o_custkey % 5 WHEN 0 THEN 'etl' WHEN 1 THEN 'ml' WHEN 2 THEN 'streaming' WHEN 3 THEN 'batch'
    ELSE 'sql' END AS job_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'cost' ELSE 'balanced' END AS priority,
  CASE c_nationkey % 2 WHEN 0 THEN 'shared' ELSE 'dedicated' END AS cluster_type,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS BIGINT) AS failed_stages,
  lower(c_mktsegment) AS team
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "task_sums": """
SELECT app_key, CAST(SUM(num_tasks) AS BIGINT) AS total_tasks, CAST(SUM(failed_tasks) AS BIGINT) AS raw_failed_tasks,
  CAST(SUM(input_bytes) AS BIGINT) AS input_bytes, CAST(SUM(output_bytes) AS BIGINT) AS output_bytes,
  CAST(SUM(shuffle_read_bytes) AS BIGINT) AS shuffle_read_bytes,
  CAST(SUM(shuffle_write_bytes) AS BIGINT) AS shuffle_write_bytes,
  CAST(SUM(memory_spilled_bytes) AS BIGINT) AS memory_spilled_bytes,
  CAST(SUM(disk_spilled_bytes) AS BIGINT) AS disk_spilled_bytes,
  CAST(SUM(run_ms) AS BIGINT) AS executor_run_time_ms, CAST(SUM(cpu_ms) AS BIGINT) AS executor_cpu_time_ms,
  CAST(SUM(gc_ms) AS BIGINT) AS jvm_gc_time_ms, CAST(MAX(peak_memory) AS BIGINT) AS peak_memory_usage,
  CAST(COUNT(DISTINCT stage_id) AS BIGINT) AS total_stages
FROM task_events GROUP BY app_key""",
    "applications": """
SELECT o.*, t.* EXCLUDE (app_key, raw_failed_tasks),
  CASE WHEN status = 'running' THEN nullif(raw_failed_tasks, 0) ELSE raw_failed_tasks END AS failed_tasks
FROM order_info o JOIN task_sums t USING (app_key)""",
    "jobs": "SELECT * REPLACE (coalesce(failed_tasks, 0) AS failed_tasks) FROM applications",
    "stages": """
SELECT app_key, stage_id, CAST(SUM(num_tasks) AS BIGINT) AS num_tasks, CAST(SUM(run_ms) AS BIGINT) AS duration_ms,
  CAST(SUM(failed_tasks) AS BIGINT) AS failed_tasks,
  CAST(SUM(input_bytes) AS BIGINT) AS input_bytes, CAST(SUM(output_bytes) AS BIGINT) AS output_bytes,
  CAST(SUM(shuffle_read_bytes) AS BIGINT) AS shuffle_read_bytes,
  CAST(SUM(shuffle_write_bytes) AS BIGINT) AS shuffle_write_bytes,
  CAST(SUM(cpu_ms) AS BIGINT) AS cpu_ms
FROM task_events GROUP BY app_key, stage_id""",
    "points": """
SELECT event_id, 'app-' || CAST(user_id % 3 AS VARCHAR) AS app_id, user_id, epoch_us(ts) AS us,
  CASE event_type WHEN 'click' THEN 'jvm_gc_time_percent' WHEN 'error' THEN 'task_failure_rate'
    WHEN 'purchase' THEN 'memory_spill_ratio' WHEN 'view' THEN 'cpu_utilization'
    ELSE 'executors_lost' END AS metric_name,
  CAST(CASE event_type WHEN 'error' THEN value / 1000 WHEN 'purchase' THEN value / 500
    WHEN 'signup' THEN floor(value / 200) ELSE value END AS DOUBLE) AS value
FROM events""",
    "feedback": """
SELECT app_key * 100 + stage_id AS session_id, supp_key AS app_key, ship_ms AS ts_ms,
  CAST(CASE part_key % 5 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 4096 WHEN 3 THEN 8192 ELSE 16384 END
    AS BIGINT) AS executor_memory,
  CAST(CASE supp_key % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS BIGINT) AS executor_cores,
  CASE WHEN tax % 3 = 2 THEN 'throughput' WHEN tax % 3 = 1 THEN 'cost' ELSE 'duration' END AS metric_name,
  run_ms AS metric_before, cpu_ms + gc_ms * 5 AS metric_after, disc * 2 AS expected_improvement, part_key
FROM task_events""",
    "requests": """
SELECT c_custkey AS request_id,
  CAST(abs(CAST(ROUND(c_acctbal*100) AS BIGINT))
    * CASE c_custkey % 10 WHEN 0 THEN 1048576 WHEN 1 THEN 131072 ELSE 4096 END AS BIGINT) AS input_bytes,
  CASE c_custkey % 5 WHEN 0 THEN 'etl' WHEN 1 THEN 'ml' WHEN 2 THEN 'streaming' WHEN 3 THEN 'batch'
    ELSE NULL END AS job_type,
  CASE c_nationkey % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'cost' ELSE 'balanced' END AS priority,
  CASE WHEN c_custkey % 2 = 0 THEN 30 END AS sla_minutes,
  CASE WHEN c_custkey % 7 < 4 THEN 5e0 END AS budget_dollars,
  CASE c_nationkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS provider
FROM customer""",
    "recommendations": """
SELECT app_key AS recommendation_id, (app_key % 40) * 1073741824 AS input_size_bytes, job_type,
  md5('{"input_size": ' || CAST((app_key % 40) * 1073741824 AS VARCHAR) || ', "job_type": "' || job_type || '"}')
    AS job_signature,
  executor_cores AS recommended_executor_cores, executor_memory_mb AS recommended_executor_memory_mb,
  num_executors AS recommended_num_executors, driver_memory_mb AS recommended_driver_memory_mb,
  duration_ms AS predicted_duration_ms,
  CASE priority WHEN 'balanced' THEN 'similarity' WHEN 'cost' THEN 'rule_based' ELSE 'ml' END
    AS recommendation_method,
  start_ms AS created_ms, CASE WHEN status <> 'running' THEN start_ms + 60000 END AS used_ms,
  CASE WHEN status = 'completed' THEN duration_ms % 101 END AS feedback_percent
FROM order_info""",
}


def with_tables(select: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Put the telemetry tables in front of a SELECT or a WITH statement."""
    ctes = {**ORACLE_TABLES, **(extra or {})}
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{name} AS ({body})" for name, body in ctes.items())
    body = select.strip()
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"
