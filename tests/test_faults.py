"""Inputs that once stopped a job, lost a value or doubled a row."""

import datetime as dt

from pyspark.sql import functions as F

from jobsight import schemas
from jobsight.operators import alerts
from jobsight.sources import event_log, sinks


def test_rule_without_cooldown_fires_at_every_trigger(spark):
    rows = [("r", "a", 0, 10, 1), ("r", "a", 0, 10, 2), ("r", "a", 0, 11, 3), ("s", "a", 5, 10, 4), ("s", "a", 5, 12, 5), ("s", "a", 5, 15, 6)]
    found = spark.createDataFrame(rows, "rule STRING, app_id STRING, cooldown_us BIGINT, us BIGINT, event_id BIGINT")
    fired = {(r.rule, r.event_id) for r in alerts.cooled_down(found).collect()}
    assert fired == {("r", 1), ("r", 2), ("r", 3), ("s", 4), ("s", 6)}


def test_replayed_first_batch_adds_nothing(spark, tmp_path):
    batch = spark.createDataFrame([("a", "x")], "app_id STRING, app_name STRING")
    batch = schemas.conform(batch.withColumn("start_time", F.lit(dt.datetime(2024, 5, 1))), schemas.APPLICATIONS, schemas.RENAMES)
    store = str(tmp_path / "store")
    for _ in range(2):
        sinks.ingest(batch, spark, store)
    assert sinks.read_applications(spark, store).count() == 1


def test_first_batch_that_failed_before_it_committed(spark, tmp_path):
    (tmp_path / "store" / "_temporary").mkdir(parents=True)
    batch = spark.createDataFrame([("a", "x")], "app_id STRING, app_name STRING")
    batch = schemas.conform(batch.withColumn("start_time", F.lit(dt.datetime(2024, 5, 1))), schemas.APPLICATIONS, schemas.RENAMES)
    sinks.ingest(batch, spark, str(tmp_path / "store"))
    assert sinks.read_applications(spark, str(tmp_path / "store")).count() == 1


def test_repeated_and_short_property_pairs(spark):
    texts = ['[["a","1"],["b","2"],["a","3"],["c"],[]]', '{"a":"1"}', "[]", None]
    out = spark.createDataFrame([(t,) for t in texts], "t STRING").select(event_log.properties(F.col("t")).alias("p")).collect()
    assert [r.p for r in out] == [{"a": "3", "b": "2"}, {"a": "1"}, {}, None]


def test_updates_are_folded_and_can_clear(spark):
    table = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "k STRING, s STRING, n INT")
    rows = [("a", "u", None, 1, None), ("a", "v", 7, 2, None), ("a", None, None, 3, None), ("b", None, 5, 1, ["s"]), ("d", "q", 1, 1, None)]
    updates = spark.createDataFrame(rows, "k STRING, s STRING, n INT, at INT, cleared_fields ARRAY<STRING>")
    out = sinks.updated(table, updates, "k", F.lit(dt.datetime(2024, 1, 1)), "at").orderBy("k").collect()
    assert [(r.k, r.s, r.n, r.updated_at is not None) for r in out] == [("a", "v", 7, True), ("b", None, 5, True), ("c", "z", 3, False)]
