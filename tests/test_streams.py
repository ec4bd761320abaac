"""Streams by event time give what the batch gives, whatever the order of arrival; late rows are counted, state goes."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from jobsight.operators import alerts, monitoring
from jobsight.streaming import feeds, processors

SECOND, HOUR = 1_000_000, 3_600_000_000
TRIGGERS = "rule string, app_id string, cooldown_us long, us long, event_id long"


def timed(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.timestamp_micros("us"))


def replayed(table, purpose, process, **how):
    replay = feeds.Replay(table, "ts", purpose)
    stream = feeds.stream_files(table.sparkSession, replay.landed, table.schema)
    return replay, replay.drain(process(replay.watermarked(stream)), **how)


def state(spark, replay, variable):
    reader = spark.read.format("statestore").option("path", f"{replay.folder}/checkpoint")
    return reader.option("stateVarName", variable).load()


@pytest.fixture(scope="module")
def hot(spark):
    """A hot key, ties, a rule without cooldown, rows without a time, over two days."""
    rnd = random.Random(3)
    rows = [("r", rnd.choice("aaab"), HOUR, rnd.randrange(48 * HOUR), i) for i in range(2000)]
    rows += [("r", "a", HOUR, rows[i][3], 5000 + i) for i in range(0, 400, 2)]
    rows += [("all", "a", 0, rnd.randrange(48 * HOUR), 9000 + i) for i in range(50)]
    return timed(spark, [*rows, ("r", "a", HOUR, None, 99), ("r", "c", HOUR, None, 98)], TRIGGERS)


def test_cooldown_stream_equals_the_batch(spark, hot):
    replay, out = replayed(hot, "cooldown", processors.cooldown_alerts)
    assert spark.read.parquet(f"{replay.folder}/out").select("_batch").distinct().count() >= 3  # alerts came out on the way
    want = alerts.cooled_down(hot.filter("us IS NOT NULL")).select("rule", "app_id", "us", "event_id")
    got = sorted(out.select(*want.columns).collect())
    assert got == sorted(want.collect()) and len(got) > 80
    assert state(spark, replay, "waiting").count() == 0


def test_an_alert_is_forgotten_after_its_cooldown(spark):
    rows = [("r", "early", HOUR, SECOND, 1), ("r", "late", HOUR, 9 * HOUR, 2)]
    replay, out = replayed(timed(spark, rows, TRIGGERS), "forget", processors.cooldown_alerts)
    assert out.count() == 2
    assert [r["key"]["app_id"] for r in state(spark, replay, "last").collect()] == ["late"]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    def land(*rows):
        timed(spark, rows, TRIGGERS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():
        return feeds.run(processors.cooldown_alerts(stream), sink, f"{tmp_path}/checkpoint")

    land(("r", "a", SECOND, 5 * HOUR, 1))
    rows = feeds.stream_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    stream, sink = rows.withWatermark("ts", feeds.WATERMARK), feeds.parquet_batches(f"{tmp_path}/out")
    assert go() == 0
    # two hours late, five minutes late, and one that lets all of them pass
    land(("r", "a", SECOND, 3 * HOUR, 2), ("r", "a", SECOND, 5 * HOUR - 300 * SECOND, 3), ("r", "b", SECOND, 9 * HOUR, 4))
    assert go() == 1
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3]


def test_status_stream_equals_the_batch(spark):
    rnd = random.Random(4)
    rows = [(min(3, rnd.randrange(9)), i, rnd.randrange(30 * HOUR), rnd.choice(["running", "failed", "completed", None])) for i in range(900)]
    table = timed(spark, rows, "user_id long, event_id long, us long, status string")
    _, out = replayed(table, "status", processors.status_changes)
    want = monitoring.status_changes(table, "user_id", F.floor(F.col("us") / HOUR))
    assert sorted(out.select(*want.columns).collect()) == sorted(want.collect())


def test_a_silent_application_is_new_again(spark):
    rows = [(1, 1, SECOND, "failed"), (1, 2, HOUR - 1, "failed"), (1, 3, 3 * HOUR, "failed"), (1, 4, 20 * HOUR, "running"), (2, 5, 20 * HOUR, None)]
    table = timed(spark, rows, "user_id long, event_id long, us long, status string")
    _, changes = replayed(table, "idle", lambda s: processors.status_changes(s, HOUR))
    assert sorted((r["event_id"], r["old_status"]) for r in changes.collect()) == [(1, "running"), (3, "running")]
    _, started = replayed(table, "sights", lambda s: processors.registrations(s, HOUR))
    assert sorted(r["user_id"] for r in started.collect()) == [1, 1, 2]


def test_history_stream_equals_the_batch_and_goes_with_its_age(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aab"), "m", rnd.randrange(20 * HOUR), i, float(i)) for i in range(800)] + [("old", "m", SECOND, 999, 1.0)]
    table = timed(spark, rows, "app_id string, metric_name string, us long, event_id long, value double")
    replay, out = replayed(
        table, "history", lambda s: processors.metric_history(s, 15, HOUR), mode="update", group=["app_id", "metric_name"]
    )
    want = monitoring.retained_history(table, 15, "1 hour").select("app_id", "metric_name", "us", "event_id", "value")
    assert sorted(out.select(*want.columns).collect()) == sorted(want.collect())
    assert {r["key"]["app_id"] for r in state(spark, replay, "points").select("key").collect()} == {"a", "b"}


def test_replay_of_an_empty_table(spark):
    replay, out = replayed(timed(spark, [], TRIGGERS), "empty", processors.cooldown_alerts)
    assert out.count() == 0


def test_state_partitions_follow_the_rows_of_a_batch(spark):
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    with feeds._stateful(spark, 1000 * feeds.STATE_ROWS + 1):
        assert int(spark.conf.get(name)) == 1001
    with feeds._stateful(spark):
        assert int(spark.conf.get(name)) == cores


def test_a_session_takes_plain_rows():
    class Value:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, new):
            self.kept = new

    def row(tie, target):
        blank = dict.fromkeys([*processors.STEP_METRICS, *processors.SESSION_CONFIG])
        return Row(**blank | {"seq": 1, "tie": tie, "target": target, "target_metric": "duration", "strategy": "moderate"})

    session = processors.TuningSession()
    session.state = Value()
    rows = [row(3, 50.0), row(1, None), row(2, 100.0)]
    (first,) = session.handleInputRows((7,), iter(rows), None)
    assert (first["session"], first["status"], first["iterations"], first["best_value"]) == (7, "active", 2, 50.0)
    (after,) = session.handleInputRows((7,), iter([row(4, 49.9)]), None)
    assert (after["status"], after["iterations"], after["best_value"]) == ("completed", 2, 49.9)
