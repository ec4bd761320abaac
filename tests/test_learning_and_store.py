"""Learned models, the store, and streams that run twice."""

import random

import pytest
from pyspark.sql import functions as F

from jobsight import schemas
from jobsight.operators import learn
from jobsight.sources import sinks


@pytest.fixture(scope="module")
def runs(spark):
    rnd = random.Random(42)
    rows = []
    for i in range(100):
        gb = rnd.randrange(1, 200)
        rows.append(
            {
                "app_id": f"app-{i}", "input_bytes": gb * 1024**3, "output_bytes": gb * 1024**2,
                "shuffle_read_bytes": 0, "shuffle_write_bytes": 1024**3, "total_stages": 5, "total_tasks": gb * 10,
                "num_executors": 2 + gb // 10, "executor_cores": 4, "executor_memory_mb": 4096 + 1024 * (gb // 50),
                "driver_memory_mb": 4096, "job_type": rnd.choice(["etl", "ml", None]), "priority": "balanced",
            }
        )
    return spark.createDataFrame(rows).cache()


def test_models_learn_predict_in_range_and_reload(spark, runs, tmp_path):
    learned = learn.train(runs, trees=10, depth=5, folds=0)
    assert learned.samples == 100 and learned.metrics["num_executors"]["r2"] > 0.8
    requests = spark.createDataFrame(
        [(1, 10 * 1024**3, "etl", "balanced", None, None), (2, 10**16, "ml", "performance", 30, None), (3, 0, None, "cost", None, 5.0)],
        "request_id long, input_bytes long, job_type string, priority string, sla_minutes int, budget_dollars double",
    )
    answers = learn.recommend(learned, requests)
    for r in answers.collect():
        for target, (low, high, _) in learn.RANGES.items():
            assert low <= r[target] <= high
        assert 0.3 <= r["confidence"] <= 0.95
    learn.save(learned, str(tmp_path / "m"))
    again = learn.recommend(learn.load(spark, str(tmp_path / "m")), requests)
    assert again.exceptAll(answers).count() == 0
    importances = learn.importance_rows(spark, learned)
    assert importances.count() == 64
    with pytest.raises(ValueError, match="lacks"):
        learn.load(spark, str(tmp_path / "nowhere"))


def test_runs_of_one_partition_are_spread_over_the_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(learn, "TARGETS", learn.TARGETS[: max(1, cores // 2)])
    rows = spark.range(0, 400, 1, 1)
    wanted = cores // len(learn.TARGETS)
    monkeypatch.setattr(learn, "TASK_RUNS", 10)
    assert learn.spread(rows, 400).rdd.getNumPartitions() == max(1, wanted)
    assert learn.spread(rows, 400).exceptAll(rows).count() == 0 and learn.spread(rows, 400).count() == 400
    # A small table, and one in more partitions already, stay as they are.
    assert learn.spread(rows, 15).rdd.getNumPartitions() == 1
    assert learn.spread(spark.range(0, 400, 1, 50), 400).rdd.getNumPartitions() == 50


def test_boosting_rounds_are_cut_from_earlier_ones_and_models_stay_the_same(runs, monkeypatch):
    often = learn.train(runs, kind="gradient_boosting", trees=5, depth=2, folds=0)
    assert {m.stages[-1].getCheckpointInterval() for m in often.models.values()} == {2}
    monkeypatch.setattr(learn, "CHECKPOINT_ROUNDS", 10)
    seldom = learn.train(runs, kind="gradient_boosting", trees=5, depth=2, folds=0)
    strip = lambda model: model.toDebugString.split("\n", 1)[1]  # noqa: E731  the first line holds a random id
    for target in learn.TARGETS:
        assert seldom.models[target].stages[-1].getCheckpointInterval() == 10
        assert strip(often.models[target].stages[-1]) == strip(seldom.models[target].stages[-1])


@pytest.fixture
def fits(monkeypatch):
    """What every fit was given, and how many were at work at once."""
    import threading

    seen, at_work, most, lock, made = [], [0], [0], threading.Lock(), learn._regressor

    def watched(*options):
        regressor = made(*options)
        fit = regressor.fit

        def counted(rows):
            with lock:
                at_work[0] += 1
                most[0] = max(most[0], at_work[0])
                seen.append((rows.rdd.getNumPartitions(), rows.columns))
            try:
                return fit(rows)
            finally:
                with lock:
                    at_work[0] -= 1

        regressor.fit = counted
        return regressor

    monkeypatch.setattr(learn, "_regressor", watched)
    return seen, most


def test_training_rows_of_many_partitions_are_gathered_on_the_cores_of_a_fit(spark, runs, fits, monkeypatch):
    seen, _ = fits
    many = spark.createDataFrame(runs.rdd.repartition(30), runs.schema)
    monkeypatch.setattr(learn, "TASK_RUNS", 10)
    learned = learn.train(many, trees=2, depth=2, folds=0)
    cores = spark.sparkContext.defaultParallelism
    # Counts of all open nodes go from every task of a level; only what a fit reads is kept.
    assert seen == [(max(1, min(cores // 4, 10)), ["features", *learn.TARGETS])] * 4
    assert learned.samples == 100


def test_fits_of_large_tables_follow_each_other_on_all_cores(spark, runs, fits, monkeypatch):
    seen, most = fits
    monkeypatch.setattr(learn, "TASK_RUNS", 10)
    monkeypatch.setattr(learn, "KEPT_BYTES", 1)
    learn.train(runs, trees=2, depth=2, folds=0)
    assert most == [1] and {n for n, _ in seen} == {min(spark.sparkContext.defaultParallelism, 10)}
    monkeypatch.undo()
    assert [learn.fits_at_once(n, "random_forest", 100) for n in (100, 900_000, 2_000_000, 9_000_000)] == [4, 4, 2, 1]
    assert learn.fits_at_once(2_000_000, "gradient_boosting", 100) == 4


def test_evaluation_reads_the_runs_once_for_all_targets(spark, runs):
    learned = learn.train(runs, trees=2, depth=2, folds=0)
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    found = learn.evaluate(learned, spark.createDataFrame(runs.rdd.map(counted), runs.schema))
    assert read.value == 100 and set(found) == set(learn.TARGETS)
    assert found["num_executors"]["r2"] > 0.5


def test_too_few_runs_are_refused(runs):
    with pytest.raises(ValueError, match="at least"):
        learn.train(runs.limit(5), folds=0)


def test_ingest_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "z")], "app_id string, app_name string").withColumn(
        "start_time", F.lit("2024-01-02").cast("timestamp")
    )
    path = str(tmp_path / "store")
    sinks.ingest(rows, spark, path)
    sinks.ingest(rows, spark, path)
    store = sinks.read_applications(spark, path)
    assert sorted(r["app_id"] for r in store.collect()) == ["a", "b"]
    assert set(schemas.APPLICATIONS.fieldNames()) <= set(store.columns)


def test_update_and_delete(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "app_id string, n int, s string")
    changes = spark.createDataFrame([("a", 5, 9), ("zz", 7, 9)], "app_id string, n int, unknown int")
    new = {r["app_id"]: r for r in sinks.updated(table, changes, "app_id", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert new["a"]["n"] == 5 and new["a"]["s"] == "x" and new["a"]["updated_at"] is not None
    assert new["b"]["n"] == 2 and new["b"]["updated_at"] is None and "zz" not in new
    assert [r["app_id"] for r in sinks.without(table, changes, "app_id").collect()] == ["b"]


def test_date_search_reads_only_its_months(spark, tmp_path):
    from jobsight.operators.search import Criteria, matching

    rows = spark.createDataFrame([(f"a{i}", f"2024-{i:02d}-15") for i in range(1, 13)], "app_id string, d string")
    path = str(tmp_path / "store")
    sinks.write_applications(rows.withColumn("start_time", F.col("d").cast("timestamp")), path)
    found = matching(sinks.read_applications(spark, path), Criteria(started_from="2024-03-01", started_to="2024-04-30"))
    assert sorted(r["app_id"] for r in found.collect()) == ["a3", "a4"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "start_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_learned_queries_share_models_of_full_size(spark, monkeypatch):
    from types import SimpleNamespace

    from jobsight.plans import recommending

    calls, saved = [], {}
    monkeypatch.setattr(learn, "train", lambda runs, **options: calls.append(options) or learn.Learned({}, {"t": {"r2": 0.5, "samples": 9.0}}))
    monkeypatch.setattr(learn, "save", lambda learned, path: saved.setdefault(path, learned))
    monkeypatch.setattr(learn, "load", lambda spark, path: saved[path])
    t = SimpleNamespace(spark=spark, sf_dir="/nowhere", apps=None)
    for _ in range(2):
        assert recommending._learned(t) is recommending._learned(t)
    recommending._learned(t, kind="gradient_boosting")
    # The operator's own number of trees and depth; folds, which change no model, only for the query that shows them.
    assert calls == [{"kind": "random_forest", "folds": 0}, {"kind": "gradient_boosting", "folds": 0}]
    assert recommending._learned(t, folds=5) is recommending._learned(t, folds=5)
    assert calls[2:] == [{"kind": "random_forest", "folds": 5}]


def test_rows_to_predict_are_spread_over_the_cores(spark):
    rows = spark.range(500).coalesce(1)
    spread = learn.over_cores(rows)
    assert spread.rdd.getNumPartitions() == max(1, spark.sparkContext.defaultParallelism)
    assert sorted(r["id"] for r in spread.collect()) == list(range(500))
