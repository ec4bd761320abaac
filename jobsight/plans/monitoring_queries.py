"""Queries: live metrics, alerts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even, ratio
from jobsight.operators import alerts, monitoring, rules
from jobsight.operators.alerts import AlertRule
from jobsight.plans.diagnosis import MEASURES, jobs, r
from jobsight.plans.registry import query
from jobsight.session import shared_dir
from jobsight.sources import sinks
from jobsight.streaming import feeds, processors

DAY_US = 86_400_000_000
_RULES = ", ".join(
    f"('{x.name}', '{x.metric_name}', '{x.condition}', {x.threshold!r}::DOUBLE, '{x.severity}')"
    for x in alerts.DEFAULT_RULES
)
_COOLDOWN_MIN = 180
_COOLDOWN = _COOLDOWN_MIN * 60_000_000
ALERT_SQL = {
    "rule_rows": f"SELECT * FROM (VALUES {_RULES}) v(rule, metric_name, condition, threshold, severity)",
    "met": """
SELECT p.*, rule, threshold, severity FROM points p JOIN rule_rows USING (metric_name)
WHERE CASE condition WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold ELSE false END""",
    "moments": "SELECT rule, app_id, us, MIN(event_id) AS event_id FROM met GROUP BY rule, app_id, us",
    "fired": f"""
SELECT rule, app_id, MIN(us) AS us FROM moments GROUP BY rule, app_id
UNION ALL SELECT f.rule, f.app_id, MIN(m.us) FROM fired f JOIN moments m ON m.rule = f.rule AND m.app_id = f.app_id
  AND m.us >= f.us + {_COOLDOWN} GROUP BY f.rule, f.app_id""",
    "alert_rows": "SELECT * FROM fired JOIN moments USING (rule, app_id, us)",
}
RULES = tuple(
    AlertRule(x.name, x.metric_name, x.condition, x.threshold, x.severity, x.title, x.message, _COOLDOWN_MIN)
    for x in alerts.DEFAULT_RULES
)


def alerting(name: str, sql: str | None, recursive: bool = True):
    extra = ALERT_SQL if recursive else {k: ALERT_SQL[k] for k in ("rule_rows", "met", "moments")}
    return query(name, sql, extra, recursive)


def found(t, rule_set=RULES, points=None):
    return alerts.triggers(t.points if points is None else points, alerts.rule_table(t.spark, rule_set))


@alerting(
    "join_07_rule_triggers",
    "SELECT rule, app_id, event_id, value, severity FROM met",
    recursive=False,
)
def _(t):
    return found(t).select("rule", "app_id", "event_id", "value", "severity")


@alerting("sca_17_alert_titles", f"""SELECT rule, event_id, CASE rule WHEN 'high_gc_time' THEN 'High GC Time'
      WHEN 'critical_gc_time' THEN 'Critical GC Time' WHEN 'memory_spilling' THEN 'Memory Spilling Detected'
      WHEN 'high_task_failure_rate' THEN 'High Task Failure Rate' WHEN 'executor_lost' THEN 'Executor Lost'
      WHEN 'low_cpu_utilization' THEN 'Low CPU Utilization' ELSE 'High Shuffle Spill' END AS title,
      CASE rule WHEN 'high_gc_time' THEN 'GC time is ' || printf('%.1f', value) || '%, exceeding 10.0% threshold'
        WHEN 'critical_gc_time' THEN 'GC time is critically high at ' || printf('%.1f', value) || '%'
        WHEN 'memory_spilling' THEN 'Memory spill ratio is ' || printf('%.2f', value) || ', data is spilling to disk'
        WHEN 'high_task_failure_rate' THEN 'Task failure rate is ' || printf('%.1f', value * 100) || '%, exceeding 5.0%'
        WHEN 'executor_lost' THEN printf('%.0f', value) || ' executor(s) have been lost'
        WHEN 'low_cpu_utilization'
          THEN 'CPU utilization is only ' || printf('%.1f', value) || '%, resources may be over-provisioned'
        ELSE 'Shuffle spill ratio is ' || printf('%.2f', value) || ', consider increasing executor memory' END AS message
    FROM met""", recursive=False)  # fmt: skip
def _(t):
    return alerts.with_texts(found(t)).select("rule", "event_id", "title", "message")


@alerting(
    "str_06_rule_table",
    "SELECT rule, COUNT(*) AS triggers FROM met WHERE rule NOT IN ('executor_lost', 'high_gc_time') GROUP BY rule "
    "UNION ALL SELECT 'odd_value', COUNT(*) FROM points WHERE metric_name = 'cpu_utilization' AND value >= 90",
    recursive=False,
)
def _(t):
    """One default rule removed, one disabled, one added."""
    kept = alerts.without_rule(alerts.DEFAULT_RULES, "executor_lost")
    off = tuple(
        AlertRule(**{**x.__dict__, "enabled": False}) if x.name == "high_gc_time" else x for x in kept
    )
    more = (*off, AlertRule("odd_value", "cpu_utilization", "gte", 90.0, "info", "Odd", "{value:.1f}"))
    return found(t, more).groupBy("rule").agg(F.count(F.lit(1)).alias("triggers"))


def replayed(t, purpose):
    """The metric points as a stream of several batches, out of order."""
    replay = feeds.Replay(t.raw("events"), "ts", purpose)
    return replay, t.streaming("events", landed=replay.landed).points


@alerting("win_13_cooldown_alerts", "SELECT rule, app_id, us, event_id FROM alert_rows")
def _(t):
    return alerts.cooled_down(found(t))


@alerting("str_05_cooldown_stream", "SELECT rule, app_id, us, event_id FROM alert_rows")
def _(t):
    replay, live = replayed(t, "alerts")
    hits = found(t, points=live).select("rule", "app_id", "ts", "us", "event_id", "cooldown_us")
    return replay.drain(processors.cooldown_alerts(replay.watermarked(hits)))


_LIFE = {
    **ALERT_SQL,
    "actions": """
SELECT 'alert-' || rule || '-' || CAST(event_id AS VARCHAR) AS alert_id, 'acknowledge' AS kind, us + 60000000 * k AS at_us,
  'user-' || CAST(k AS VARCHAR) AS actor FROM met, (VALUES (1), (2)) v(k) WHERE severity <> 'info'
UNION ALL SELECT 'alert-' || rule || '-' || CAST(event_id AS VARCHAR), 'resolve', us + 3600000000 * k, 'user-0'
  FROM met, (VALUES (1), (2)) v(k) WHERE severity IN ('info', 'warning')""",
    "alerts_now": """
SELECT a.*, x.* EXCLUDE (alert_id), 'alert-' || rule || '-' || CAST(event_id AS VARCHAR) AS alert_id FROM alert_rows a
LEFT JOIN (SELECT alert_id, MIN(at_us) FILTER (kind = 'acknowledge') AS acknowledged_us,
    arg_min(actor, at_us) FILTER (kind = 'acknowledge') AS acknowledged_by, MIN(at_us) FILTER (kind = 'resolve') AS resolved_us
  FROM actions GROUP BY alert_id) x ON x.alert_id = 'alert-' || a.rule || '-' || CAST(a.event_id AS VARCHAR)""",
}


def _alerts_now(t):
    """Alerts, the serious ones acknowledged and the harmless ones resolved, each twice over, which counts once."""
    hits = found(t).withColumn("alert_id", alerts.alert_id(F.col("rule"), F.col("event_id")))
    k = F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    ack = (
        hits.filter(F.col("severity") != "info")
        .select("alert_id", "us", k)
        .select(
            "alert_id",
            F.lit("acknowledge").alias("kind"),
            (F.col("us") + F.col("k") * 60_000_000).alias("at_us"),
            F.concat(F.lit("user-"), F.col("k").cast("string")).alias("by"),
        )
    )
    done = (
        hits.filter(F.col("severity").isin("info", "warning"))
        .select("alert_id", "us", k)
        .select(
            "alert_id",
            F.lit("resolve").alias("kind"),
            (F.col("us") + F.col("k") * F.lit(3_600_000_000)).alias("at_us"),
            F.lit("user-0").alias("by"),
        )
    )
    fired = alerts.cooled_down(found(t)).withColumn("alert_id", alerts.alert_id(F.col("rule"), F.col("event_id")))
    return alerts.lifecycle(fired, ack.unionByName(done))


def living(name: str, sql: str):
    return query(name, sql, _LIFE, recursive=True)


@living("str_07_alert_lifecycle", "SELECT alert_id, app_id, acknowledged_us, acknowledged_by, resolved_us FROM alerts_now")
def _(t):
    return _alerts_now(t).select("alert_id", "app_id", "acknowledged_us", "acknowledged_by", "resolved_us")


@living("flt_19_active_alerts", "SELECT alert_id, us FROM alerts_now WHERE resolved_us IS NULL AND app_id = 'app-1'")
def _(t):
    return alerts.active(_alerts_now(t), "app-1").select("alert_id", "us")


@living(
    "flt_19_alert_history",
    """SELECT alert_id, us FROM alerts_now WHERE resolved_us IS NOT NULL AND us > epoch_us(TIMESTAMP '2024-01-05')
    ORDER BY us DESC, alert_id LIMIT 100""",
)
def _(t):
    return alerts.alert_history(_alerts_now(t), since_us=1704412800000000).select("alert_id", "us")


_LATEST = """
SELECT app_id, metric_name, arg_max(value, (us, event_id)) AS value, MAX(us) AS us FROM points GROUP BY app_id, metric_name"""


@query("str_01_latest_metrics", _LATEST)
def _(t):
    live = monitoring.latest_metrics(t.streaming("events").points)
    out = feeds.drain(live, "latest", "update", ["app_id", "metric_name"])
    return out.select("app_id", "metric_name", "value", F.unix_micros("last_updated").alias("us"))


_HISTORY = """
SELECT app_id, metric_name, us, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY app_id, metric_name
    ORDER BY us DESC, event_id DESC) AS n FROM (SELECT *, MAX(us) OVER (PARTITION BY app_id, metric_name) AS now FROM points) p
  WHERE us > now - {age}) x WHERE n <= {points}"""


@query("win_07_metric_retention", _HISTORY.format(age=DAY_US, points=20))
def _(t):
    kept = monitoring.retained_history(t.points, max_points=20, max_age="1 day")
    return kept.select("app_id", "metric_name", F.unix_micros("ts").alias("us"), "event_id", "value")


@query("str_02_metric_history", _HISTORY.format(age=DAY_US, points=20))
def _(t):
    replay, live = replayed(t, "history")
    points = live.select("app_id", "metric_name", "ts", F.unix_micros("ts").alias("us"), "event_id", "value")
    history = processors.metric_history(replay.watermarked(points), 20, DAY_US)
    return replay.drain(history, "update", ["app_id", "metric_name"])


@query(
    "str_02_history_range",
    """SELECT event_id, value FROM points WHERE app_id = 'app-2' AND metric_name = 'cpu_utilization'
      AND us > epoch_us(TIMESTAMP '2024-01-20')""",
)
def _(t):
    return monitoring.history_of(t.points, "app-2", "cpu_utilization", "2024-01-20").select("event_id", "value")


@query("str_03_registration", "SELECT DISTINCT user_id, 'application_started' AS event FROM points")
def _(t):
    replay, live = replayed(t, "started")
    sights = live.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return replay.drain(processors.registrations(replay.watermarked(sights)))


_UPDATES = """
SELECT user_id, event_id, us, CASE metric_name WHEN 'executors_lost' THEN 'completed' WHEN 'jvm_gc_time_percent' THEN 'running'
    WHEN 'task_failure_rate' THEN CASE WHEN value > 0.05e0 THEN 'failed' END END AS status,
  CASE WHEN metric_name = 'cpu_utilization' THEN CAST(floor(value) AS BIGINT) END AS active_tasks,
  CASE WHEN metric_name = 'memory_spill_ratio' THEN CAST(floor(value * 100) AS BIGINT) END AS executors FROM points"""
_STATUS = """
SELECT user_id, arg_max(status, (us, event_id)) FILTER (status IS NOT NULL) AS status,
  arg_max(active_tasks, (us, event_id)) FILTER (active_tasks IS NOT NULL) AS active_tasks,
  arg_max(executors, (us, event_id)) FILTER (executors IS NOT NULL) AS executors, MAX(us) - MIN(us) AS running_us
FROM updates GROUP BY user_id"""
FIELDS = ["status", "active_tasks", "executors"]


def updates(points):
    """Status updates as they come: every event gives some fields and leaves the others out."""
    metric, value = F.col("metric_name"), F.col("value")
    return points.select(
        "user_id",
        "event_id",
        "ts",
        F.when(metric == "executors_lost", "completed")
        .when(metric == "jvm_gc_time_percent", "running")
        .when((metric == "task_failure_rate") & (value > 0.05), "failed")
        .alias("status"),
        F.when(metric == "cpu_utilization", F.floor(value).cast("long")).alias("active_tasks"),
        F.when(metric == "memory_spill_ratio", F.floor(value * 100).cast("long")).alias("executors"),
    )


def live(name: str, sql: str):
    return query(name, sql, {"updates": _UPDATES, "status_now": _STATUS})


@live("str_04_status_updates", "SELECT * FROM status_now")
def _(t):
    state = monitoring.latest_status(updates(t.streaming("events").points), "user_id", FIELDS)
    return feeds.drain(state, "status", "update", ["user_id"])


@live(
    "agg_21_live_counters",
    """SELECT COUNT(*) FILTER (coalesce(status, 'running') = 'running') AS running_apps,
      CAST(SUM(coalesce(active_tasks, 0)) AS BIGINT) AS active_tasks, CAST(SUM(coalesce(executors, 0)) AS BIGINT) AS executors
    FROM status_now""",
)
def _(t):
    return monitoring.live_counters(monitoring.latest_status(updates(t.points), "user_id", FIELDS))


_CHANGED = """SELECT user_id, event_id, before AS old_status, status AS new_status FROM (
  SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY us, event_id), 'running') AS before FROM updates
  WHERE status IS NOT NULL) x WHERE status <> before"""


@live("win_08_status_changes", _CHANGED)
def _(t):
    block = F.floor(F.unix_micros("ts") / DAY_US).cast("long")
    return monitoring.status_changes(updates(t.points), "user_id", block)


@live("str_04_change_events", _CHANGED)
def _(t):
    replay, live = replayed(t, "changes")
    given = updates(live).filter(F.col("status").isNotNull())
    rows = given.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "status")
    return replay.drain(processors.status_changes(replay.watermarked(rows)))


@query(
    "str_08_fan_out",
    "SELECT 'columnar' AS sink, COUNT(*) AS rows FROM points UNION ALL SELECT 'json', COUNT(*) FROM points WHERE value > 100",
)
def _(t):
    """One stream, two subscribers: every point to Parquet, the large ones to JSON."""
    folder = shared_dir(t.spark, "fan-out")
    stream = t.streaming("events").points

    def large_as_json(batch, number):
        batch.filter(F.col("value") > 100).write.mode("overwrite").json(f"{folder}/json/batch={number}")

    feeds.run(
        stream, feeds.fan_out(feeds.parquet_batches(f"{folder}/columnar"), large_as_json), f"{folder}/checkpoint"
    )
    columnar = feeds.read_batches(t.spark, stream.schema, f"{folder}/columnar").select(F.lit("columnar").alias("sink"))
    as_json = t.spark.read.schema("event_id BIGINT").json(f"{folder}/json").select(F.lit("json").alias("sink"))
    return columnar.unionByName(as_json).groupBy("sink").agg(F.count(F.lit(1)).alias("rows"))


@query("udx_03_subscriber", "SELECT severity, COUNT(*) AS alerts FROM met GROUP BY severity", ALERT_SQL, recursive=True)
def _(t):
    """A subscriber of the trigger stream that keeps a count per severity and batch."""
    folder = shared_dir(t.spark, "subscriber")

    def count(batch, number):
        per_severity = batch.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))
        per_severity.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    feeds.run(found(t, points=t.streaming("events").points), count, f"{folder}/checkpoint")
    counts = t.spark.read.schema("severity STRING, alerts BIGINT").parquet(f"{folder}/counts")
    return counts.groupBy("severity").agg(F.sum("alerts").alias("alerts"))


@query(
    "str_09_incremental_ingest",
    "SELECT app_id, status, duration_ms FROM order_info",
)
def _(t):
    """Runs ingested from a stream, twice over; the store takes each of them once."""
    store = shared_dir(t.spark, "ingest")
    wanted = ["app_id", "app_name", "user_name", "start_time", "end_time", "duration_ms", "status", "tags"]

    for turn in (1, 2):
        stream = t.streaming("orders").orders.select(*wanted)

        def append_new(batch, number):
            sinks.ingest(batch, batch.sparkSession, f"{store}/applications")
            # A replay of the same batch adds nothing.
            sinks.ingest(batch, batch.sparkSession, f"{store}/applications")

        feeds.run(stream, append_new, f"{store}/checkpoint-{turn}")
    return sinks.read_applications(t.spark, f"{store}/applications").select("app_id", "status", "duration_ms")


@query(
    "str_12_health_windows",
    f"""SELECT w * 86400000 AS window_ms, supp_key, {r('CAST(failed AS DOUBLE) / tasks')} AS task_failure_rate,
      {r('CAST(gc AS DOUBLE) / run * 100')} AS jvm_gc_time_percent, {r('CAST(cpu AS DOUBLE) / run * 100')} AS cpu_utilization,
      {r('CAST(spilled AS DOUBLE) / input')} AS memory_spill_ratio
    FROM (SELECT ship_ms // 86400000 AS w, supp_key, SUM(num_tasks) AS tasks, SUM(failed_tasks) AS failed, SUM(run_ms) AS run,
      SUM(cpu_ms) AS cpu, SUM(gc_ms) AS gc, SUM(input_bytes) AS input, SUM(memory_spilled_bytes) AS spilled
      FROM task_events GROUP BY 1, 2) x""",
)
def _(t):
    stream = t.streaming("lineitem").tasks.withColumn("ts", F.timestamp_millis("ship_ms"))
    windows = monitoring.health_windows(stream.withWatermark("ts", feeds.WATERMARK), "supp_key", "ts")
    out = feeds.drain(windows, "windows", "update", ["window_start", "supp_key"], t.raw("lineitem").count())
    measured = ["task_failure_rate", "jvm_gc_time_percent", "cpu_utilization", "memory_spill_ratio"]
    return out.select(
        F.unix_millis("window_start").alias("window_ms"), "supp_key", *[half_even(c, 6).alias(c) for c in measured]
    )


@query(
    "udx_01_custom_rule",
    """SELECT app_id, 'SLOW001' AS rule_id, 'info' AS severity FROM measures WHERE rate < 1000 AND duration_ms > 0
    UNION ALL SELECT app_id, 'MEM001', 'critical' FROM measures WHERE disk_spilled_bytes + memory_spilled_bytes > 0""",
    MEASURES,
)
def _(t):
    """A rule of the user beside a built-in one."""
    slow = rules.Rule(
        "SLOW001",
        "Slow data flow",
        rules.INFO,
        applies=lambda: (F.col("duration_ms") > 0)
        & (ratio(F.col("input_bytes") + F.col("output_bytes"), "duration_ms") < 1000),
    )
    return rules.evaluate(jobs(t), [slow, rules.DEFAULT_RULES[0]]).select("app_id", "rule_id", "severity")

