"""Patterns by all their conditions, machines by dominance and blocks by rows, against the plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsight.operators import feedback, ordered, staircase

HOLDS = {
    "gt": lambda v, t: v > t,
    "gte": lambda v, t: v >= t,
    "lt": lambda v, t: v < t,
    "lte": lambda v, t: v <= t,
    "eq": lambda v, t: v == t,
    "neq": lambda v, t: v != t,
}
PATTERNS = "name string, confidence double, conditions array<struct<metric: string, operator: string, threshold: double>>"


def test_patterns_match_by_all_their_conditions(spark, monkeypatch):
    rng = np.random.default_rng(1)
    metrics = ["gc", "cpu", "spill"]
    patterns = [("always", 0.1, []), ("never", 0.99, [("absent", "gt", 0.0)])]
    for i in range(60):
        chosen = rng.choice(metrics, int(rng.integers(1, 4)), replace=False)
        conditions = [(str(m), str(rng.choice(list(HOLDS))), float(rng.integers(0, 8))) for m in chosen]
        patterns.append((f"p{i}", float(rng.integers(2, 9)) / 10, conditions))
    runs = [(i, {str(m): float(rng.integers(0, 8)) for m in rng.choice(metrics, int(rng.integers(0, 4)), replace=False)}) for i in range(300)]
    runs += [(300, {}), (301, {"other": 1.0}), (302, {"gc": None, "cpu": 3.0})]
    # A third of the runs are alike.
    runs += [(1000 + i, {"gc": 4.0, "cpu": 4.0, "spill": 4.0}) for i in range(150)]

    def fits(values, conditions):
        return all(values.get(m) is not None and HOLDS[o](values[m], t) for m, o, t in conditions)

    want = {(i, n) for i, v in runs for n, _, c in patterns if fits(v, c)}
    table = spark.createDataFrame(runs, "id int, metrics map<string, double>")
    rules = spark.createDataFrame(patterns, PATTERNS)
    for whole in (20_000, 10):
        monkeypatch.setattr(ordered, "WHOLE_ROWS", whole)
        monkeypatch.setattr(ordered.equi_depth, "__defaults__", (whole,))
        pairs, cells = feedback.matched(table, rules, "name", "id")
        assert {tuple(r) for r in cells.join(pairs, "cell").select("id", "name").collect()} == want
    best = {i: min((-c, n) for n, c, _ in patterns if (i, n) in want) for i, _ in runs}
    got = {r.id: (-r.confidence, r.name) for r in feedback.recommend(table, rules, "name", "id").collect()}
    assert got == best


def test_no_patterns_and_no_runs(spark):
    table = spark.createDataFrame([(1, {"gc": 1.0})], "id int, metrics map<string, double>")
    rules = spark.createDataFrame([("p", 0.5, [("gc", "gt", 0.0)])], PATTERNS)
    assert feedback.recommend(table.limit(0), rules, "name", "id").count() == 0
    assert feedback.recommend(table, rules.limit(0), "name", "id").count() == 0
    assert [tuple(r) for r in feedback.recommend(table, rules, "name", "id").collect()] == [(1, "p", 0.5)]


CATALOG = "provider string, instance_type string, vcpus int, memory_gb double, hourly_price double, local_storage_gb int"


@pytest.mark.parametrize("prefer", [False, True])
def test_staircase_is_the_sorted_list_of_all_that_fit(spark, prefer):
    rng = np.random.default_rng(2)
    sizes = lambda: (int(rng.choice([1, 2, 4, 8, 16, 48])), float(rng.choice([2, 4, 7.5, 16, 64])))
    rows = [(str(rng.choice(["a", "b"])), f"m{i:05d}", *sizes(), float(rng.integers(1, 40)) / 10, int(rng.choice([0, 100]))) for i in range(3000)]
    rows += [("c", "only", 3, 3.0, 1.0, 0), ("c", "no price", 64, 64.0, None, 0), ("d", "unasked", 1, 1.0, 1.0, 0)]
    needs = [(p, v, m) for p in ("a", "b", "c", "none", staircase.ANY, None) for v in (0.0, 1.0, 3.0, 48.0, 49.0) for m in (0.5, 7.5, 8.0, 64.0)]
    last = F.col("local_storage_gb") == 0 if prefer else None
    got = staircase.fitting(spark.createDataFrame(needs, "provider string, vcpus double, memory_gb double"), spark.createDataFrame(rows, CATALOG), 4, last=last)
    found = {(r.provider, r.vcpus, r.memory_gb): (r.fitting, [b.instance_type for b in r.best]) for r in got.collect()}
    want = {}
    for p, v, m in needs:
        fit = [r for r in rows if p in (r[0], staircase.ANY) and r[2] >= v and r[3] >= m and r[4] is not None]
        if fit:
            fit.sort(key=lambda r: (prefer and r[5] == 0, r[4], r[1]))
            want[p, v, m] = len(fit), [r[1] for r in fit[:4]]
    assert found == want


def test_runs_of_a_hot_shape_share_a_look_up(spark):
    runs = spark.range(5000).select(F.col("id").alias("app_id"), F.lit("a").alias("provider"), F.lit(2).alias("executor_cores"), F.lit(2048).alias("executor_memory_mb"))
    catalog = spark.createDataFrame([("a", "x", 2, 4.0, 0.2, 0), ("a", "y", 4, 2.0, 0.1, 0), ("a", "z", 1, 8.0, 0.01, 0)], CATALOG)
    out = staircase.fitting_runs(runs, catalog, 2, F.col("provider"), ["app_id"])
    assert out.count() == 5000
    assert {(r.fitting, tuple(b.instance_type for b in r.best)) for r in out.select("fitting", "best").distinct().collect()} == {(2, ("y", "x"))}
    assert staircase.fitting_runs(runs, catalog.limit(0), 2, F.col("provider"), ["app_id"]).count() == 0


def test_blocks_of_a_hot_key_are_bounded(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") < 50_000, "hot").otherwise("cold").alias("k"), (F.col("id") % 1000 + F.when(F.col("id") % 7 == 0, 10**9).otherwise(0)).alias("at"))
    depths = ordered.equi_depth(rows, ["k"], "at").groupBy("k", "_depth").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("k", "_depth").collect()
    hot = [d for d in depths if d.k == "hot"]
    assert len([d for d in depths if d.k == "cold"]) == 1
    assert max(d.n for d in hot) < 1000 and sum(d.n for d in hot) == 50_000
    assert all(a.hi < b.lo for a, b in zip(hot, hot[1:], strict=False))
