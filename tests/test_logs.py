"""Event logs from files: the known fixture, broken logs, and logs written by Spark itself."""

import gzip
import json
import subprocess
import sys

from pyspark.sql import functions as F

from jobsight.sources import event_log


def task(i, **metrics):
    body = {
        "Input Metrics": {"Bytes Read": 1024**3},
        "Output Metrics": {"Bytes Written": 512 * 1024**2},
        "Shuffle Read Metrics": {"Total Bytes Read": 256 * 1024**2},
        "Shuffle Write Metrics": {"Bytes Written": 256 * 1024**2},
        "Executor Run Time": 5500,
        "Executor CPU Time": 5000,
        "JVM GC Time": 250,
        "Memory Bytes Spilled": 0,
        "Disk Bytes Spilled": 0,
        "Peak Execution Memory": (4 + i) * 1024**3,
        **metrics,
    }
    return {"Event": "SparkListenerTaskEnd", "Task Info": {"Task ID": i, "Successful": True}, "Task Metrics": body}


EVENTS = [
    {"Event": "SparkListenerApplicationStart", "App ID": "app-1", "App Name": "t", "User": "u", "Timestamp": 1700000000000},
    {
        "Event": "SparkListenerEnvironmentUpdate",
        "Spark Properties": [
            ["spark.executor.memory", "8g"], ["spark.executor.cores", "4"], ["spark.executor.instances", "10"],
        ],
    },
    {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Stage Name": "a"}},
    {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Name": "b"}},
    task(0),
    task(1),
    {"Event": "SparkListenerApplicationEnd", "Timestamp": 1700003600000},
]


def test_known_log_and_broken_logs(spark, tmp_path):
    text = "\n".join(json.dumps(e) for e in EVENTS)
    (tmp_path / "good.log").write_text(text + "\n{broken\n\nnot json\n")
    with gzip.open(tmp_path / "deep.log.gz", "wt") as f:
        f.write(text.replace("app-1", "app-2").replace('{"Event": "SparkListenerApplicationEnd"', '{"Event": "x"'))
    (tmp_path / "empty.log").write_text("")
    (tmp_path / ".hidden.log").write_text(text)
    (tmp_path / "headless.log").write_text(json.dumps(EVENTS[-1]))
    lines = event_log.read_lines(spark, str(tmp_path))
    rows = {r["app_id"]: r for r in event_log.applications(lines, cpu_unit="ms").collect()}
    assert set(rows) == {"app-1", "app-2"}
    r = rows["app-1"]
    assert (r["duration_ms"], r["total_tasks"], r["failed_tasks"], r["total_stages"]) == (3_600_000, 2, 0, 2)
    assert (r["input_bytes"], r["output_bytes"]) == (2 * 1024**3, 1024**3)
    assert (r["shuffle_read_bytes"], r["shuffle_write_bytes"]) == (512 * 1024**2, 512 * 1024**2)
    assert (r["executor_run_time_ms"], r["executor_cpu_time_ms"], r["jvm_gc_time_ms"]) == (11_000, 10_000, 500)
    assert r["peak_memory_usage"] == 5 * 1024**3
    assert (r["executor_memory_mb"], r["executor_cores"], r["num_executors"], r["driver_memory_mb"]) == (8192, 4, 10, 1024)
    assert rows["app-2"]["end_time"] is None and rows["app-2"]["duration_ms"] is None
    assert event_log.rejects(lines).count() == 2


def test_first_environment_event_counts(spark, tmp_path):
    later = {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": [["spark.executor.cores", "1"], ["a", "b"]]}
    single = "\n".join(json.dumps(e) for e in [*EVENTS[:2], later, *EVENTS[2:]])
    (tmp_path / "one.log").write_text(single)
    rolling = tmp_path / "eventlog_v2_app-2"
    rolling.mkdir()
    (rolling / "events_2_app-2").write_text("\n".join(json.dumps(e) for e in EVENTS[:2]).replace("app-1", "app-2"))
    (rolling / "events_10_app-2").write_text(json.dumps(later))
    rows = event_log.applications(event_log.read_lines(spark, str(tmp_path)), cpu_unit="ms").collect()
    assert {(r["app_id"], r["executor_cores"]) for r in rows} == {("app-1", 4), ("app-2", 4)}


JOB = """
import sys
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").appName("logged").config("spark.ui.enabled", "false")
     .config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false")
     .config("spark.eventLog.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "3").getOrCreate())
s.range(0, 50000, 1, 4).groupBy((__import__("pyspark.sql.functions", fromlist=["col"]).col("id") % 7).alias("k")).count().collect()
print(s.sparkContext.applicationId)
s.stop()
"""


def test_log_of_a_real_application(spark, tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", JOB, str(tmp_path)], capture_output=True, text=True, timeout=180, check=True
    )
    app = done.stdout.strip().splitlines()[-1]
    lines = event_log.read_lines(spark, str(tmp_path))
    row = event_log.applications(lines).filter(F.col("app_id") == app).first()
    assert row["app_name"] == "logged" and row["duration_ms"] > 0
    assert row["total_tasks"] > 4 and row["shuffle_write_bytes"] > 0 and row["shuffle_read_bytes"] > 0
    assert 0 < row["executor_cpu_time_ms"] <= row["executor_run_time_ms"] * 2
    assert event_log.stages(lines).agg(F.sum("num_tasks")).first()[0] == row["total_tasks"]


def test_rendered_logs_join_the_tables_once_for_runs_and_once_for_tasks(spark):
    from jobsight.plans import landed
    from jobsight.plans.tables import Tables

    plan = landed.log_lines(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3
