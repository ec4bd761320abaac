"""Queries: diagnosis of runs and fleet summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even
from jobsight.operators import diagnose, rules, summaries
from jobsight.operators.ordered import block_of, with_previous
from jobsight.plans.registry import query
from jobsight.plans.tables import Tables
from jobsight.schemas import zero_filled


def jobs(t: Tables):
    return zero_filled(t.apps)


def r(x: str, digits: int = 6) -> str:
    """The rounding of ``half_even`` in SQL."""
    scale = float(10**digits)
    return f"(round_even(({x}) * {scale:.1f}::DOUBLE, 0) / {scale:.1f}::DOUBLE)"


def dbl(x: float) -> str:
    return f"({x!r}::DOUBLE)"


# Measures of a run, spelled out for the SQL side.
MEASURES = {
    "measures": """
SELECT *, executor_run_time_ms * num_executors * executor_cores AS cpu_total,
  CASE WHEN executor_run_time_ms * num_executors * executor_cores > 0 THEN
    CAST(executor_cpu_time_ms AS DOUBLE) / (executor_run_time_ms * num_executors * executor_cores)
    ELSE 0e0 END AS cpu_share,
  CAST(peak_memory_usage AS DOUBLE) / (executor_memory_mb * 1048576 * num_executors) AS mem_share,
  CASE WHEN duration_ms > 0 THEN CAST(input_bytes + output_bytes AS DOUBLE) / duration_ms ELSE 0e0 END AS rate,
  CASE WHEN input_bytes > 0 THEN CAST(shuffle_read_bytes + shuffle_write_bytes AS DOUBLE) / input_bytes
    ELSE 0e0 END AS shuffle_share,
  CASE WHEN input_bytes > 0 THEN CAST(memory_spilled_bytes + disk_spilled_bytes AS DOUBLE) / input_bytes
    ELSE 0e0 END AS spill_share,
  CASE WHEN input_bytes > 0 THEN CAST(disk_spilled_bytes AS DOUBLE) / input_bytes ELSE 0e0 END AS disk_share,
  CASE WHEN input_bytes > 0 THEN CAST(shuffle_write_bytes AS DOUBLE) / input_bytes ELSE 0e0 END AS growth,
  CASE WHEN executor_run_time_ms > 0 THEN CAST(jvm_gc_time_ms AS DOUBLE) / executor_run_time_ms ELSE 0e0 END
    AS gc_share,
  CASE WHEN total_tasks > 0 THEN CAST(failed_tasks AS DOUBLE) / total_tasks ELSE 0e0 END AS fail_share,
  num_executors * executor_cores * 2 AS ideal_tasks
FROM jobs""",
    "efficiency": f"""
SELECT *, {r('least(1e0, cpu_share)', 3)} AS cpu_efficiency, {r('least(1e0, mem_share)', 3)} AS memory_efficiency,
  {r('least(1e0, rate / 104857.6::DOUBLE)', 3)} AS io_efficiency,
  {r('1e0 - least(1e0, shuffle_share)', 3)} AS shuffle_efficiency,
  {r('''(least(1e0, cpu_share) + least(1e0, mem_share) + least(1e0, rate / 104857.6::DOUBLE)
     + (1e0 - least(1e0, shuffle_share))) / 4e0''', 3)} AS overall_efficiency,
  {r('least(1e0, CASE WHEN executor_run_time_ms > 0 THEN CAST(executor_cpu_time_ms AS DOUBLE) / executor_run_time_ms ELSE 0e0 END)', 3)}
    AS cpu_efficiency_task
FROM measures""",
    "labels_of": """
SELECT *, concat_ws(',',
  CASE WHEN executor_run_time_ms > 0 AND cpu_share > 0.85e0 THEN 'CPU_BOUND'
       WHEN executor_run_time_ms > 0 AND cpu_share < 0.3e0 THEN 'CPU_UNDERUTILIZED' END,
  CASE WHEN spill_share > 0.05e0 THEN 'MEMORY_PRESSURE' END,
  CASE WHEN gc_share > 0.1e0 THEN 'GC_OVERHEAD' END,
  CASE WHEN shuffle_share > 0.5e0 THEN 'SHUFFLE_HEAVY' END,
  CASE WHEN total_tasks > 0 AND ideal_tasks > 0 AND CAST(total_tasks AS DOUBLE) / ideal_tasks < 0.5e0
         THEN 'LOW_PARALLELISM'
       WHEN total_tasks > 0 AND ideal_tasks > 0 AND CAST(total_tasks AS DOUBLE) / ideal_tasks > 10
         THEN 'EXCESSIVE_TASKS' END) AS bottlenecks
FROM measures""",
    "issue_rows": """
SELECT app_id, 1 AS seq, 'DATA_SKEW' AS type, CASE WHEN growth > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  'Consider salting keys or repartitioning data' AS recommendation FROM measures WHERE growth > 2
UNION ALL SELECT app_id, 2, 'DISK_SPILL',
  CASE WHEN disk_spilled_bytes / 1073741824e0 > 10 THEN 'HIGH' ELSE 'MEDIUM' END,
  'Increase executor memory or reduce partition size' FROM measures WHERE disk_spilled_bytes > 0
UNION ALL SELECT app_id, 3, 'MEMORY_SPILL', 'MEDIUM', 'Increase spark.memory.fraction or executor memory'
  FROM measures WHERE memory_spilled_bytes > 0
UNION ALL SELECT app_id, 4, 'TASK_FAILURES', CASE WHEN fail_share > 0.05e0 THEN 'HIGH' ELSE 'MEDIUM' END,
  'Check executor logs for OOM errors or data issues' FROM measures WHERE failed_tasks > 0
UNION ALL SELECT app_id, 5, 'STAGE_FAILURES', 'HIGH', 'Review stage details for root cause'
  FROM measures WHERE failed_stages > 0
UNION ALL SELECT app_id, 6, 'LOW_PARALLELISM', 'MEDIUM',
  'Increase partition count with repartition() or coalesce()' FROM measures
  WHERE total_tasks > 0 AND total_tasks < ideal_tasks / 2
UNION ALL SELECT app_id, 7, 'HIGH_GC_TIME', CASE WHEN gc_share < 0.2e0 THEN 'MEDIUM' ELSE 'HIGH' END,
  'Increase executor memory or tune GC settings' FROM measures WHERE gc_share > 0.1e0""",
    "health": f"""
SELECT *, greatest(0e0, {r('''1e0 - least(0.3e0, fail_share * 3e0) - least(0.2e0, disk_share * 0.5e0)
  - CASE WHEN gc_share > 0.1e0 THEN least(0.15e0, gc_share * 0.5e0) ELSE 0e0 END
  - least(0.2e0, failed_stages * 0.1e0)''', 3)}) AS health_score FROM measures""",
    "parts": """
SELECT *, CASE WHEN input_bytes / 1073741824e0 > 100 THEN least(ideal_tasks * 2, 2000)
  WHEN input_bytes / 1073741824e0 > 10 THEN ideal_tasks ELSE greatest(ideal_tasks // 2, 20) END AS partitions
FROM measures""",
    "rule_flags": """
SELECT *, disk_spilled_bytes + memory_spilled_bytes > 0 AS mem001,
  input_bytes > 0 AND memory_spilled_bytes > input_bytes * 0.1e0 AS mem002,
  input_bytes > 0 AND shuffle_write_bytes > input_bytes * 5 AS shuffle001,
  abs(partitions - 200) > 50 AS partition001,
  duration_ms > 0 AND jvm_gc_time_ms > duration_ms * 0.1e0 AS gc001,
  total_tasks > 0 AND failed_tasks > total_tasks * 0.05e0 AS skew001,
  total_tasks > 100 AND input_bytes > 0 AND CAST(input_bytes AS DOUBLE) / total_tasks / 1048576 < 10 AS io001
FROM parts""",
    "finding_rows": """
SELECT app_id, 'MEM001' AS rule_id, 'critical' AS severity, 'Memory Spilling Detected' AS title,
  CAST(executor_memory_mb AS VARCHAR) || ' MB' AS current_value,
  CAST(CAST(floor(executor_memory_mb * 1.5e0) AS BIGINT) AS VARCHAR) || ' MB' AS recommended_value
  FROM rule_flags WHERE mem001
UNION ALL SELECT app_id, 'MEM002', 'warning', 'Memory Fraction Optimization', 'Default (0.6)', '0.8'
  FROM rule_flags WHERE mem002
UNION ALL SELECT app_id, 'SHUFFLE001', 'critical', 'Excessive Shuffle Detected', NULL,
  'Use broadcast joins or repartition' FROM rule_flags WHERE shuffle001
UNION ALL SELECT app_id, 'PARTITION001', 'warning', 'Suboptimal Partition Count', '200 (default)',
  CAST(partitions AS VARCHAR) FROM rule_flags WHERE partition001
UNION ALL SELECT app_id, 'GC001', 'critical', 'High GC Pressure', NULL, '< 10% GC time' FROM rule_flags WHERE gc001
UNION ALL SELECT app_id, 'SKEW001', 'warning', 'Potential Data Skew',
  CAST(failed_tasks AS VARCHAR) || '/' || CAST(total_tasks AS VARCHAR) || ' tasks failed',
  'Add salting or use adaptive execution' FROM rule_flags WHERE skew001
UNION ALL SELECT app_id, 'IO001', 'warning', 'Too Many Small Files', NULL, 'Coalesce files to 128-256 MB each'
  FROM rule_flags WHERE io001""",
}

EFFICIENCY_LIST = ", ".join([*diagnose.EFFICIENCIES, "cpu_efficiency_task"])


def diag(name: str, sql: str | None):
    return query(name, sql, MEASURES)


@diag("dia_01_resource_efficiency", f"SELECT app_id, {EFFICIENCY_LIST} FROM efficiency")
def _(t):
    return jobs(t).select("app_id", *[c.alias(n) for n, c in diagnose.efficiency().items()])


@diag("dia_02_bottlenecks", "SELECT app_id, bottlenecks FROM labels_of")
def _(t):
    return jobs(t).select("app_id", F.array_join(diagnose.bottlenecks(), ",").alias("bottlenecks"))


@diag("dia_03_issues", "SELECT app_id, type, severity, recommendation FROM issue_rows")
def _(t):
    found = jobs(t).select("app_id", F.inline(diagnose.issues()))
    return found.select("app_id", "type", "severity", "recommendation")


@diag("dia_04_health_score", "SELECT app_id, health_score FROM health")
def _(t):
    return jobs(t).select("app_id", diagnose.health_score().alias("health_score"))


@diag(
    "dia_05_job_analysis",
    """SELECT h.app_id, h.app_name, h.duration_ms, e.overall_efficiency, l.bottlenecks, h.health_score,
      coalesce(i.issues, '') AS issues
    FROM health h JOIN efficiency e USING (app_id) JOIN labels_of l USING (app_id)
    LEFT JOIN (SELECT app_id, string_agg(type || ':' || severity, ',' ORDER BY seq) AS issues FROM issue_rows
      GROUP BY app_id) i USING (app_id)""",
)
def _(t):
    issue = F.zip_with("issues.type", "issues.severity", lambda a, b: F.concat(a, F.lit(":"), b))
    return diagnose.analyze(jobs(t)).select(
        "app_id",
        "app_name",
        "duration_ms",
        "resource_efficiency.overall_efficiency",
        F.array_join("bottlenecks", ",").alias("bottlenecks"),
        "health_score",
        F.array_join(issue, ",").alias("issues"),
    )


@diag(
    "dia_05_suggestions",
    """SELECT app_id, h.health_score, type AS issue, severity, recommendation
    FROM issue_rows JOIN health h USING (app_id)""",
)
def _(t):
    return diagnose.suggestions(jobs(t)).drop("description")


def _rule_query(name: str, rule_id: str, sql_columns: str, spark_columns: list[str]):
    @diag(name, f"SELECT app_id, {sql_columns} FROM finding_rows WHERE rule_id = '{rule_id}'")
    def _(t):
        only = [x for x in rules.DEFAULT_RULES if x.rule_id == rule_id]
        return rules.evaluate(jobs(t), only).select("app_id", *spark_columns)


_BOTH = ["rule_id", "severity", "title", "current_value", "recommended_value"]
_SOME = ["rule_id", "severity", "title", "recommended_value"]
_rule_query("dia_06_rule_memory_spill", "MEM001", ", ".join(_BOTH), _BOTH)
_rule_query("dia_07_rule_memory_fraction", "MEM002", ", ".join(_BOTH), _BOTH)
_rule_query("dia_08_rule_shuffle_explosion", "SHUFFLE001", ", ".join(_SOME), _SOME)
_rule_query("dia_09_rule_partition_count", "PARTITION001", ", ".join(_BOTH), _BOTH)
_rule_query("dia_10_rule_gc_pressure", "GC001", ", ".join(_SOME), _SOME)
_rule_query("dia_11_rule_data_skew", "SKEW001", ", ".join(_BOTH), _BOTH)
_rule_query("dia_12_rule_small_files", "IO001", ", ".join(_SOME), _SOME)


@diag("dia_13_rule_set", f"SELECT app_id, {', '.join(_SOME)} FROM finding_rows")
def _(t):
    return rules.evaluate(jobs(t)).select("app_id", *_SOME)


@diag("dia_13_critical_findings", "SELECT app_id, rule_id, title FROM finding_rows WHERE severity = 'critical'")
def _(t):
    return rules.evaluate(jobs(t), severity=rules.CRITICAL).select("app_id", "rule_id", "title")


@diag(
    "dia_14_rule_report",
    """SELECT j.app_id, j.app_name, coalesce(c.total, 0) AS total_recommendations, coalesce(c.critical, 0) AS critical,
      coalesce(c.warnings, 0) AS warnings, CAST(0 AS BIGINT) AS info,
      greatest(0e0, 100e0 - coalesce(c.critical, 0) * 30e0 - coalesce(c.warnings, 0) * 10e0) AS health_score,
      coalesce(c.rule_ids, '') AS rule_ids
    FROM jobs j LEFT JOIN (SELECT app_id, COUNT(*) AS total, COUNT(*) FILTER (severity = 'critical') AS critical,
        COUNT(*) FILTER (severity = 'warning') AS warnings, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids
      FROM finding_rows GROUP BY app_id) c USING (app_id)""",
)
def _(t):
    ids = F.sort_array("rule_ids")
    return rules.report(jobs(t)).select(
        "app_id",
        "app_name",
        *[F.col(c).cast("long") for c in ("total_recommendations", "critical", "warnings", "info")],
        "health_score",
        F.array_join(ids, ",").alias("rule_ids"),
    )


@diag(
    "set_04_merged_rule_configs",
    """SELECT app_id,
      CASE WHEN mem001 THEN CAST(CAST(floor(executor_memory_mb * 1.5e0) AS BIGINT) AS VARCHAR) || 'm' END
        AS executor_memory,
      CASE WHEN mem002 THEN '0.8' END AS memory_fraction,
      CASE WHEN shuffle001 THEN '104857600' END AS broadcast_threshold,
      CASE WHEN partition001 THEN CAST(partitions AS VARCHAR) END AS shuffle_partitions,
      CASE WHEN skew001 THEN 'true' END AS skew_join,
      CASE WHEN io001 THEN '268435456' END AS max_partition_bytes,
      CAST(CAST(mem001 AS INT) + 2 * CAST(mem002 AS INT) + CAST(shuffle001 AS INT) + CAST(partition001 AS INT)
        + CAST(gc001 AS INT) + 2 * CAST(skew001 AS INT) + CAST(io001 AS INT) AS BIGINT) AS entries
    FROM rule_flags""",
)
def _(t):
    c = F.col("spark_configs")
    return rules.report(jobs(t)).select(
        "app_id",
        c["spark.executor.memory"].alias("executor_memory"),
        c["spark.memory.fraction"].alias("memory_fraction"),
        c["spark.sql.autoBroadcastJoinThreshold"].alias("broadcast_threshold"),
        c["spark.sql.shuffle.partitions"].alias("shuffle_partitions"),
        c["spark.sql.adaptive.skewJoin.enabled"].alias("skew_join"),
        c["spark.sql.files.maxPartitionBytes"].alias("max_partition_bytes"),
        F.size(c).cast("long").alias("entries"),
    )


@diag(
    "dia_15_apply_findings",
    """SELECT app_id, CASE WHEN mem001 THEN greatest(executor_memory_mb, CAST(floor(executor_memory_mb * 1.5e0) AS BIGINT))
        ELSE executor_memory_mb END AS recommended_executor_memory_mb,
      CASE WHEN shuffle001 THEN CAST(floor(driver_memory_mb * 1.2e0) AS BIGINT) ELSE driver_memory_mb END
        AS recommended_driver_memory_mb
    FROM rule_flags""",
)
def _(t):
    return rules.report(jobs(t)).select(
        "app_id", "recommended_executor_memory_mb", "recommended_driver_memory_mb"
    )


@diag(
    "dia_16_quick_check",
    f"""SELECT app_id, {r('duration_ms / 60000e0', 3)} AS duration_min, {r('input_bytes / 1073741824e0', 3)} AS input_gb,
      {r('shuffle_write_bytes / 1073741824e0', 3)} AS shuffle_gb,
      concat_ws(',', CASE WHEN disk_spilled_bytes > 0 THEN 'disk_spill' END, CASE WHEN gc_share > 0.1e0 THEN 'high_gc' END,
        CASE WHEN failed_tasks > 0 THEN 'task_failures' END, CASE WHEN growth > 0.5e0 THEN 'high_shuffle' END) AS findings,
      NOT (disk_spilled_bytes > 0 OR gc_share > 0.1e0 OR failed_tasks > 0 OR growth > 0.5e0) AS well_optimized
    FROM measures""",
)
def _(t):
    return diagnose.quick_check(jobs(t)).select(
        "app_id",
        *[half_even(c, 3).alias(c) for c in ("duration_min", "input_gb", "shuffle_gb")],
        F.array_join("findings", ",").alias("findings"),
        "well_optimized",
    )


def consecutive_runs(t: Tables):
    """Every run beside the run of the same name before it."""
    fields = ["app_id", *diagnose.RESOURCE_FIELDS, *diagnose.PERFORMANCE_FIELDS, *diagnose.EFFICIENCIES]
    rows = diagnose.with_efficiency(jobs(t))
    paired = with_previous(rows, ["app_name"], block_of("start_ms"), ["start_ms", "app_id"], fields, "job1")
    return paired.filter(F.col("job1").isNotNull()).select("job1", F.struct(*fields).alias("job2"))


_PAIRS = """
SELECT app_id AS job2_id, lag(app_id) OVER w AS job1_id, duration_ms AS d2, lag(duration_ms) OVER w AS d1,
  executor_memory_mb AS m2, lag(executor_memory_mb) OVER w AS m1, num_executors AS n2, lag(num_executors) OVER w AS n1,
  input_bytes AS i2, lag(input_bytes) OVER w AS i1, shuffle_write_bytes AS s2, lag(shuffle_write_bytes) OVER w AS s1,
  overall_efficiency AS e2, lag(overall_efficiency) OVER w AS e1
FROM efficiency WINDOW w AS (PARTITION BY app_name ORDER BY start_ms, app_id)"""


@query(
    "join_12_run_pairs",
    "SELECT job1_id, job2_id, d1 AS duration1_ms, d2 AS duration2_ms FROM pairs WHERE job1_id IS NOT NULL",
    {**MEASURES, "pairs": _PAIRS},
)
def _(t):
    return consecutive_runs(t).select(
        F.col("job1.app_id").alias("job1_id"),
        F.col("job2.app_id").alias("job2_id"),
        F.col("job1.duration_ms").alias("duration1_ms"),
        F.col("job2.duration_ms").alias("duration2_ms"),
    )


@query(
    "dia_17_compare_runs",
    f"""SELECT job1_id, job2_id, n2 - n1 AS num_executors_diff,
      {r('CAST(n2 - n1 AS DOUBLE) / n1 * 100', 1)} AS num_executors_pct,
      m2 - m1 AS executor_memory_mb_diff, d2 - d1 AS duration_ms_diff,
      {r('CAST(d2 - d1 AS DOUBLE) / d1 * 100', 1)} AS duration_ms_pct,
      CASE WHEN i1 <> 0 THEN {r('CAST(i2 - i1 AS DOUBLE) / i1 * 100', 1)} ELSE 0e0 END AS input_bytes_pct,
      CASE WHEN s1 <> 0 THEN {r('CAST(s2 - s1 AS DOUBLE) / s1 * 100', 1)} ELSE 0e0 END AS shuffle_write_bytes_pct,
      {r('e2 - e1', 3)} AS overall_efficiency_diff,
      CASE WHEN d2 < d1 * 0.8e0 THEN 'job2' WHEN d1 < d2 * 0.8e0 THEN 'job1' END AS faster_hint,
      CASE WHEN e2 > e1 + 0.1e0 THEN 'job2' WHEN e1 > e2 + 0.1e0 THEN 'job1' END AS efficient_hint
    FROM pairs WHERE job1_id IS NOT NULL""",
    {**MEASURES, "pairs": _PAIRS},
)
def _(t):
    return diagnose.compare_pairs(consecutive_runs(t)).select(
        "job1_id",
        "job2_id",
        "num_executors_diff",
        "num_executors_pct",
        "executor_memory_mb_diff",
        "duration_ms_diff",
        "duration_ms_pct",
        "input_bytes_pct",
        "shuffle_write_bytes_pct",
        "overall_efficiency_diff",
        "faster_hint",
        "efficient_hint",
    )


@query(
    "agg_01_statistics",
    """SELECT COUNT(*) AS total_jobs, CAST(SUM(duration_ms) AS DOUBLE) / COUNT(duration_ms) AS avg_duration_ms,
      CAST(SUM(input_bytes) AS BIGINT) AS total_input_bytes, CAST(SUM(output_bytes) AS BIGINT) AS total_output_bytes
    FROM applications""",
)
def _(t):
    return summaries.statistics(t.apps)


@query("agg_02_runs_per_name", "SELECT app_name, COUNT(*) AS runs FROM applications GROUP BY app_name")
def _(t):
    return summaries.runs_per_name(t.orders.join(t.task_sums.select("app_key"), "app_key", "left_semi"))


_SUMMARY = f"""COUNT(*) AS total_jobs, CAST(SUM(duration_ms) AS DOUBLE) / COUNT(nullif(duration_ms, 0)) AS avg_duration_ms,
  CAST(median(nullif(duration_ms, 0)) AS DOUBLE) AS median_duration_ms,
  MIN(nullif(duration_ms, 0)) AS min_duration_ms, MAX(duration_ms) AS max_duration_ms,
  {r('stddev_samp(nullif(duration_ms, 0))', 1)} AS std_duration_ms,
  CAST(SUM(input_bytes) AS BIGINT) AS total_input_bytes, CAST(SUM(output_bytes) AS BIGINT) AS total_output_bytes,
  CAST(SUM(input_bytes) AS DOUBLE) / COUNT(*) AS avg_input_bytes,
  CAST(SUM(output_bytes) AS DOUBLE) / COUNT(*) AS avg_output_bytes,
  {r('CAST(SUM(total_tasks) - SUM(failed_tasks) AS DOUBLE) / CAST(SUM(total_tasks) AS DOUBLE)', 4)} AS task_success_rate"""


def _fleet(df):
    return df.withColumn("std_duration_ms", half_even("std_duration_ms", 1)).drop(
        "avg_cpu_efficiency", "avg_memory_efficiency", "avg_io_efficiency", "avg_overall_efficiency"
    )


@diag("agg_03_fleet_summary", f"SELECT {_SUMMARY} FROM efficiency")
def _(t):
    return _fleet(summaries.fleet_summary(jobs(t)))


@diag("agg_03_fleet_summary_by_name", f"SELECT app_name, {_SUMMARY} FROM efficiency GROUP BY app_name")
def _(t):
    return _fleet(summaries.fleet_summary(jobs(t), ["app_name"]))


@diag(
    "agg_04_mean_efficiency",
    "SELECT app_name, "
    + ", ".join(
        f"{r(f'AVG({c})')} AS avg_{c}"
        for c in ("cpu_efficiency", "memory_efficiency", "io_efficiency", "overall_efficiency")
    )
    + " FROM efficiency GROUP BY app_name",
)
def _(t):
    names = ["cpu_efficiency", "memory_efficiency", "io_efficiency", "overall_efficiency"]
    means = diagnose.with_efficiency(jobs(t)).groupBy("app_name")
    return means.agg(*[half_even(F.avg(n), 6).alias(f"avg_{n}") for n in names])


@diag(
    "agg_05_common_issues",
    f"""SELECT type, COUNT(*) AS count, {r('COUNT(*) * 100e0 / (SELECT COUNT(*) FROM jobs)', 6)} AS percentage
    FROM issue_rows GROUP BY type ORDER BY count DESC, type LIMIT 5""",
)
def _(t):
    return summaries.common_issues(jobs(t)).withColumn("percentage", half_even("percentage", 6))


@diag(
    "agg_06_findings_by_severity",
    """SELECT app_name, COUNT(*) FILTER (severity = 'critical') AS critical,
      COUNT(*) FILTER (severity = 'warning') AS warning, COUNT(*) FILTER (severity = 'info') AS info
    FROM finding_rows JOIN jobs USING (app_id) GROUP BY app_name""",
)
def _(t):
    return rules.severity_totals(jobs(t), "app_name")


@diag(
    "agg_13_compare_runs_of_user",
    f"""SELECT user_name, compared_count, fastest, fastest_ms, slowest, slowest_ms, most_efficient,
      {r('best', 3)} AS best_throughput_gbps, least_efficient, {r('worst', 3)} AS worst_throughput_gbps,
      spilling, failing, spilling > 0 AND spilling < compared_count AS spill_hint,
      failing > 0 AND failing < compared_count AS reliability_hint,
      CASE WHEN high_memory < avg_memory * 0.8e0 THEN CAST(floor(high_memory) AS BIGINT) END AS memory_hint_mb,
      {r('per_hour', 6)} AS best_gb_per_executor_hour
    FROM (SELECT user_name, COUNT(*) AS compared_count, arg_min(app_id, (duration_ms, app_id)) AS fastest,
        MIN(duration_ms) AS fastest_ms, arg_min(app_id, (-duration_ms, app_id)) AS slowest,
        MAX(duration_ms) AS slowest_ms, arg_min(app_id, (-tp, app_id)) AS most_efficient, MAX(tp) AS best,
        arg_min(app_id, (tp, app_id)) AS least_efficient, MIN(tp) AS worst,
        COUNT(*) FILTER (spill_share > 0) AS spilling, COUNT(*) FILTER (failed_tasks > 0) AS failing,
        CAST(SUM(executor_memory_mb) AS DOUBLE) / COUNT(*) AS avg_memory, MAX(ph) AS per_hour,
        CAST(SUM(executor_memory_mb) FILTER (tp > top * 0.8e0) AS DOUBLE) / COUNT(*) FILTER (tp > top * 0.8e0)
          AS high_memory
      FROM (SELECT *, MAX(tp) OVER (PARTITION BY user_name) AS top FROM (
        SELECT *, (input_bytes / 1073741824e0) / (duration_ms / 1000e0) AS tp,
          (input_bytes / 1073741824e0) / (num_executors * duration_ms / 3600000e0) AS ph FROM measures) x) y
      GROUP BY user_name) z""",
)
def _(t):
    out = summaries.compare_groups(jobs(t), "user_name")
    return out.withColumn("best_gb_per_executor_hour", half_even("best_gb_per_executor_hour", 6))


_DAY = "FROM applications GROUP BY start_day"


@query(
    "agg_15_daily_duration",
    f"SELECT start_day AS day, {r('CAST(SUM(duration_ms) AS DOUBLE) / COUNT(*) / 60000', 2)} AS avg_minutes {_DAY}",
)
def _(t):
    return summaries.daily(t.apps).select("day", "avg_minutes")


@query(
    "agg_16_daily_success_rate",
    f"""SELECT start_day AS day,
      {r("CAST(COUNT(*) FILTER (status = 'completed') AS DOUBLE) / COUNT(*) * 100", 1)} AS success_percent {_DAY}""",
)
def _(t):
    return summaries.daily(t.apps).select("day", "success_percent")


@query("agg_17_status_distribution", "SELECT status, COUNT(*) AS runs FROM applications GROUP BY status")
def _(t):
    return summaries.status_counts(t.apps)


@query(
    "agg_18_daily_cost",
    f"""SELECT start_day AS day,
      {r('CAST(SUM(num_executors * duration_ms) AS DOUBLE) / 3600000 * 0.1e0', 2)} AS cost {_DAY}""",
)
def _(t):
    return summaries.daily(t.apps).select("day", "cost")


@query(
    "agg_19_daily_volume",
    f"""SELECT start_day AS day, {r('CAST(SUM(input_bytes) AS DOUBLE) / 1073741824e0', 2)} AS input_gb,
      {r('CAST(SUM(output_bytes) AS DOUBLE) / 1073741824e0', 2)} AS output_gb {_DAY}""",
)
def _(t):
    return summaries.daily(t.apps).select("day", "input_gb", "output_gb")


@query(
    "agg_20_dashboard_counters",
    """SELECT COUNT(*) AS total_jobs, COUNT(*) FILTER (status = 'completed') AS successful_jobs,
      COUNT(*) FILTER (status = 'failed') AS failed_jobs,
      CAST(SUM(duration_ms) AS DOUBLE) / COUNT(*) FILTER (duration_ms > 0) AS avg_duration_ms FROM applications""",
)
def _(t):
    return summaries.dashboard(t.apps)
