"""Queries: searching and shaping the job store."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even
from jobsight.operators import search, shapes
from jobsight.operators.search import Criteria
from jobsight.plans.diagnosis import r
from jobsight.plans.registry import query
from jobsight.schemas import zero_filled

GB = 1024**3
DAY = 86_400_000


def _found(name: str, criteria: Criteria, where: str):
    """All runs that meet one criterion."""

    @query(name, f"SELECT app_id, duration_ms FROM applications WHERE {where}")
    def _(t):
        return search.matching(t.apps, criteria).select("app_id", "duration_ms")


_found("flt_01_name_contains", Criteria(name_contains="AUTO"), "app_name ILIKE '%auto%'")
_found(
    "flt_02_input_size_range", Criteria(input_range=(GB, 50 * GB)), f"input_bytes BETWEEN {GB} AND {50 * GB}"
)
_found(
    "flt_03_input_size_tolerance",
    Criteria(input_near=3 * GB + 1, input_tolerance=0.25),
    f"input_bytes BETWEEN CAST(floor({3 * GB + 1} * 0.75e0) AS BIGINT) AND CAST(floor({3 * GB + 1} * 1.25e0) AS BIGINT)",
)
_found("flt_04_executor_range", Criteria(executor_range=(5, 12)), "num_executors BETWEEN 5 AND 12")
_found("flt_05_duration_range", Criteria(duration_range=(None, 9_000_000)), "duration_ms <= 9000000")
_found("flt_06_status", Criteria(status="failed"), "status = 'failed'")
_found(
    "flt_07_successful_only", Criteria(successful_only=True), "failed_tasks = 0 OR failed_tasks IS NULL"
)
_found(
    "flt_08_min_success_rate",
    Criteria(min_success_rate=0.9),
    "total_tasks > 0 AND total_tasks - coalesce(failed_tasks, 0) >= total_tasks * 0.9e0",
)
_found(
    "flt_09_start_range",
    Criteria(started_from="1997-01-01", started_to="1998-12-31"),
    "start_day BETWEEN '1997-01-01' AND '1998-12-31'",
)
_found(
    "flt_10_cluster_and_version",
    Criteria(cluster_type="shared", spark_version="3."),
    "cluster_type = 'shared' AND spark_version LIKE '3.%'",
)
_found("flt_17_job_type_tag", Criteria(job_type="ml"), "job_type = 'ml'")


@query(
    "flt_11_composite_search",
    f"""SELECT app_id, app_name, input_bytes FROM applications
    WHERE app_name ILIKE '%machinery%' AND input_bytes BETWEEN {GB} AND {200 * GB} AND num_executors >= 3
      AND status = 'completed' AND (failed_tasks = 0 OR failed_tasks IS NULL) AND start_day >= '1996-01-01'
    ORDER BY end_ms DESC NULLS LAST, app_id LIMIT 10""",
)
def _(t):
    wanted = Criteria(
        name_contains="machinery",
        input_range=(GB, 200 * GB),
        executor_range=(3, None),
        status="completed",
        successful_only=True,
        started_from="1996-01-01",
    )
    return search.search(t.apps, wanted, limit=10).select("app_id", "app_name", "input_bytes")


@query(
    "flt_12_recent_days",
    f"""SELECT app_id, start_ms FROM applications WHERE start_ms >= epoch_ms(TIMESTAMP '2001-08-01') - 30 * {DAY}::BIGINT
    ORDER BY start_ms DESC, app_id LIMIT 100""",
)
def _(t):
    return search.recent(t.apps, now="2001-08-01").select("app_id", "start_ms")


@query(
    "flt_13_input_range_strict",
    f"""SELECT app_id, input_bytes FROM applications WHERE input_bytes BETWEEN {GB} AND {4 * GB} AND failed_tasks = 0
    ORDER BY end_ms DESC NULLS LAST, app_id LIMIT 50""",
)
def _(t):
    return search.by_input_range(t.apps, GB, 4 * GB).select("app_id", "input_bytes")


@query(
    "flt_14_successful_jobs",
    """SELECT app_id, duration_ms FROM applications WHERE (failed_tasks = 0 OR failed_tasks IS NULL)
      AND duration_ms IS NOT NULL AND end_ms IS NOT NULL ORDER BY end_ms DESC, app_id LIMIT 100""",
)
def _(t):
    return search.successful(t.apps).select("app_id", "duration_ms")


@query(
    "flt_15_point_lookup",
    "SELECT app_id, app_name, status, input_bytes FROM applications WHERE app_id = 'app-000000007'",
)
def _(t):
    return search.lookup(t.apps, "app_id", "app-000000007").select("app_id", "app_name", "status", "input_bytes")


_PAGE_WHERE = "app_name ILIKE '%building%' AND duration_ms >= 2000 * 1000 AND duration_ms <= 40000 * 1000"


def _page(t):
    return search.page(t.apps, Criteria(name_contains="building"), offset=20, limit=25, min_seconds=2000, max_seconds=40000)


@query(
    "flt_16_paged_jobs",
    f"""SELECT app_id, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%dT%H:%M:%S') AS start_time, duration_ms
    FROM applications WHERE {_PAGE_WHERE} ORDER BY start_ms DESC, app_id LIMIT 25 OFFSET 20""",
)
def _(t):
    iso = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time")
    return _page(t)[0].select("app_id", iso, "duration_ms")


@query("flt_16_paged_jobs_total", f"SELECT COUNT(*) AS total FROM applications WHERE {_PAGE_WHERE}")
def _(t):
    return _page(t)[1]


@query(
    "flt_18_recent_recommendations",
    """SELECT recommendation_id, job_signature, feedback_percent FROM recommendations
    WHERE feedback_percent IS NOT NULL ORDER BY created_ms DESC, recommendation_id LIMIT 50""",
)
def _(t):
    rows = search.recent_recommendations(t.recommendations, with_feedback=True)
    return rows.select("recommendation_id", "job_signature", "feedback_percent")


@query(
    "flt_20_recent_feedback",
    """SELECT session_id, ts_ms, metric_name FROM feedback WHERE app_key = 7 AND ts_ms > epoch_ms(TIMESTAMP '1997-01-01')
    ORDER BY ts_ms DESC, session_id, part_key, app_key LIMIT 100""",
)
def _(t):
    rows = search.recent_feedback(t.feedback, app_key=7, since_ms=852076800000)
    return rows.select("session_id", "ts_ms", "metric_name")


@query(
    "flt_23_trainable_jobs",
    """SELECT app_id FROM applications WHERE executor_cores > 0 AND executor_memory_mb > 0 AND num_executors > 0
      AND driver_memory_mb > 0 AND input_bytes > 0""",
)
def _(t):
    return search.trainable(t.apps).select("app_id")


@query(
    "prj_01_zero_filled",
    "SELECT app_id, coalesce(failed_tasks, 0) AS failed_tasks, duration_ms, input_bytes FROM applications",
)
def _(t):
    return zero_filled(t.apps).select("app_id", "failed_tasks", "duration_ms", "input_bytes")


@query(
    "prj_02_nested_record",
    """SELECT app_id, status, num_executors, driver_memory_mb, total_tasks, failed_tasks, disk_spilled_bytes,
      cluster_type, job_type FROM applications""",
)
def _(t):
    return shapes.job_record(t.apps).select(
        "app_id",
        "status",
        F.col("configuration.num_executors").cast("long").alias("num_executors"),
        F.col("configuration.driver_memory_mb").cast("long").alias("driver_memory_mb"),
        "metrics.total_tasks",
        "metrics.failed_tasks",
        "metrics.disk_spilled_bytes",
        "environment.cluster_type",
        F.col("tags")["job_type"].alias("job_type"),
    )


@query(
    "prj_03_display_row",
    f"""SELECT substr(app_id, 1, 20) AS app_id, substr(app_name, 1, 30) AS name,
      strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d %H:%M') AS started,
      {r('duration_ms / 60000e0', 1)} AS minutes, {r('input_bytes / 1073741824e0', 2)} AS input_gb,
      num_executors, executor_cores, CAST(executor_memory_mb // 1024 AS VARCHAR) || 'GB' AS memory,
      CAST(duration_ms // 60000 AS VARCHAR) || 'm ' || CAST(duration_ms % 60000 // 1000 AS VARCHAR) || 's' AS took
    FROM applications""",
)
def _(t):
    return shapes.display_row(t.apps)


@query(
    "prj_04_submit_arguments",
    """SELECT recommendation_id, 'spark-submit --num-executors ' || CAST(recommended_num_executors AS VARCHAR)
      || ' --executor-cores ' || CAST(recommended_executor_cores AS VARCHAR)
      || ' --executor-memory ' || CAST(recommended_executor_memory_mb AS VARCHAR)
      || 'm --driver-memory ' || CAST(recommended_driver_memory_mb AS VARCHAR) || 'm' AS command,
      '--conf spark.driver.memory=' || CAST(recommended_driver_memory_mb AS VARCHAR)
      || 'm --conf spark.executor.cores=' || CAST(recommended_executor_cores AS VARCHAR)
      || ' --conf spark.executor.instances=' || CAST(recommended_num_executors AS VARCHAR)
      || ' --conf spark.executor.memory=' || CAST(recommended_executor_memory_mb AS VARCHAR) || 'm' AS conf
    FROM recommendations""",
)
def _(t):
    mb = lambda c: F.concat(F.col(c).cast("string"), F.lit("m"))
    config = F.create_map(
        F.lit("spark.executor.memory"), mb("recommended_executor_memory_mb"),
        F.lit("spark.executor.instances"), F.col("recommended_num_executors").cast("string"),
        F.lit("spark.executor.cores"), F.col("recommended_executor_cores").cast("string"),
        F.lit("spark.driver.memory"), mb("recommended_driver_memory_mb"),
    )
    command = shapes.submit_command(
        "recommended_num_executors",
        "recommended_executor_cores",
        "recommended_executor_memory_mb",
        "recommended_driver_memory_mb",
    )
    return t.recommendations.select("recommendation_id", command.alias("command"), shapes.conf_arguments(config).alias("conf"))


@query(
    "join_01_application_stages",
    """SELECT app_id, app_name, stage_id, num_tasks, s.duration_ms AS stage_ms FROM order_info o
    JOIN stages s USING (app_key)""",
)
def _(t):
    apps = t.orders.select("app_key", "app_id", "app_name")
    stages = t.stages.select("app_key", "stage_id", "num_tasks", F.col("duration_ms").alias("stage_ms"))
    return apps.join(stages, "app_key").drop("app_key")


@query(
    "join_02_new_rows_only",
    """SELECT app_id FROM order_info o WHERE NOT EXISTS (SELECT 1 FROM recommendations q
      WHERE q.recommendation_id = o.app_key AND q.used_ms IS NOT NULL)""",
)
def _(t):
    used = t.recommendations.filter(F.col("used_ms").isNotNull()).select(F.col("recommendation_id").alias("app_key"))
    return t.orders.select("app_key", "app_id").join(used, "app_key", "left_anti").select("app_id")


@query("join_03_found_runs", "SELECT app_id, duration_ms FROM applications")
def _(t):
    found, _missing = search.found_and_missing(t.orders.select("app_id"), t.apps)
    return found.select("app_id", "duration_ms")


@query(
    "join_03_missing_ids",
    "SELECT app_id FROM order_info WHERE app_key NOT IN (SELECT app_key FROM task_events)",
)
def _(t):
    # the ids themselves are asked for, so the task side is reduced to its keys before the anti join
    known = t.orders.join(t.tasks.select("app_key"), "app_key", "left_semi").select("app_id")
    return search.found_and_missing(t.orders.select("app_id"), known)[1]


@query(
    "set_01_requested_minus_found",
    "SELECT app_key FROM order_info EXCEPT ALL SELECT DISTINCT app_key FROM task_events",
)
def _(t):
    return t.orders.select("app_key").exceptAll(t.tasks.select("app_key").distinct())


@query(
    "agg_07_average_feedback",
    """SELECT CAST(SUM(feedback_percent) AS DOUBLE) / COUNT(feedback_percent) / 100 AS avg_feedback
    FROM recommendations""",
)
def _(t):
    rated = F.sum("feedback_percent").cast("double") / F.nullif(F.count("feedback_percent"), F.lit(0)) / 100
    return t.recommendations.agg(F.coalesce(rated, F.lit(0.0)).alias("avg_feedback"))


@query(
    "win_01_latest_recommendation",
    """SELECT job_signature, recommendation_id, recommended_num_executors, created_ms FROM recommendations
    QUALIFY row_number() OVER (PARTITION BY job_signature ORDER BY created_ms DESC, recommendation_id DESC) = 1""",
)
def _(t):
    recs = t.recommendations.withColumn("recommended_num_executors", F.col("recommended_num_executors").cast("long"))
    return search.latest_per_key(
        recs,
        "job_signature",
        ["created_ms", "recommendation_id"],
        ["recommendation_id", "recommended_num_executors", "created_ms"],
    )


@query(
    "win_02_slowest_stages",
    """SELECT app_key, stage_id, duration_ms FROM stages
    QUALIFY row_number() OVER (PARTITION BY app_key ORDER BY duration_ms DESC, stage_id) <= 3""",
)
def _(t):
    slow = W.partitionBy("app_key").orderBy(F.desc("duration_ms"), "stage_id")
    ranked = t.stages.select("app_key", "stage_id", "duration_ms", F.row_number().over(slow).alias("rank"))
    return ranked.filter("rank <= 3").drop("rank")


@query(
    "win_12_last_ten_runs",
    """SELECT app_id, substr(app_name, 1, 20) AS name, num_executors,
      (round_even(executor_memory_mb / 1024e0 * 10, 0) / 10) AS memory_gb, executor_cores
    FROM order_info ORDER BY start_ms DESC, app_id LIMIT 10""",
)
def _(t):
    last = t.orders.orderBy(F.desc("start_ms"), "app_id").limit(10)
    return last.select(
        "app_id",
        F.substring("app_name", 1, 20).alias("name"),
        F.col("num_executors").cast("long"),
        half_even(F.col("executor_memory_mb") / 1024.0, 1).alias("memory_gb"),
        F.col("executor_cores").cast("long"),
    )


@query(
    "top_01_newest_first",
    "SELECT app_id, start_ms FROM order_info ORDER BY start_ms DESC, app_id LIMIT 50",
)
def _(t):
    return search.newest(t.orders, by="start_time", limit=50).select("app_id", "start_ms")


@query(
    "top_02_closest_input_size",
    f"SELECT app_id, input_bytes FROM applications ORDER BY abs(input_bytes - {10 * GB}), app_id LIMIT 25",
)
def _(t):
    return search.closest_size(t.apps, 10 * GB, 25).select("app_id", "input_bytes")


@query(
    "top_03_offset_page",
    "SELECT app_id FROM order_info ORDER BY start_ms DESC, app_id LIMIT 50 OFFSET 100",
)
def _(t):
    return t.orders.orderBy(F.desc("start_ms"), "app_id").offset(100).limit(50).select("app_id")


@query(
    "rec_21_feedback_lifecycle",
    """SELECT job_signature, COUNT(*) AS given, COUNT(used_ms) AS used, COUNT(feedback_percent) AS rated,
      CAST(SUM(feedback_percent) AS DOUBLE) / COUNT(feedback_percent) / 100 AS avg_score
    FROM recommendations GROUP BY job_signature""",
)
def _(t):
    """Usage and rating events, appended to the log, folded back onto their recommendation."""
    recs = t.recommendations
    event = lambda kind, at, score: recs.filter(F.col(at).isNotNull()).select(
        "recommendation_id", F.lit(kind).alias("kind"), F.col(at).alias("at_ms"), score.alias("score")
    )
    log = event("used", "used_ms", F.lit(None).cast("long")).unionByName(
        recs.filter(F.col("feedback_percent").isNotNull()).select(
            "recommendation_id",
            F.lit("rated").alias("kind"),
            F.col("created_ms").alias("at_ms"),
            F.col("feedback_percent").alias("score"),
        )
    )
    state = log.groupBy("recommendation_id").agg(
        F.max(F.when(F.col("kind") == "used", F.col("at_ms"))).alias("used_at"),
        F.max_by("score", F.when(F.col("kind") == "rated", F.col("at_ms"))).alias("feedback"),
    )
    joined = recs.select("recommendation_id", "job_signature").join(state, "recommendation_id", "left")
    return joined.groupBy("job_signature").agg(
        F.count(F.lit(1)).alias("given"),
        F.count("used_at").alias("used"),
        F.count("feedback").alias("rated"),
        (F.sum("feedback").cast("double") / F.nullif(F.count("feedback"), F.lit(0)) / 100).alias("avg_score"),
    )
