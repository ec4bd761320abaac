"""The ways around hot keys give what the plain computation gives."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobsight.operators import alerts, neighbors, ordered, tuning, workloads


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(20)}", rnd.randrange(5000), i, rnd.randrange(-50, 50)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, ms long, id long, v long").cache()


@pytest.mark.parametrize("width", [1, 97, 10**9])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_aggregates(hot, width, inclusive):
    got = ordered.with_running(
        hot, ["k"], ordered.block_of("ms", width), ["ms", "id"],
        {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, inclusive,
    )
    w = W.partitionBy("k").orderBy("ms", "id").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = hot.select("*", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("width", [1, 97, 10**9])
def test_previous_row(hot, width):
    got = ordered.with_previous(hot, ["k"], ordered.block_of("ms", width), ["ms", "id"], ["id"], "p")
    want = hot.withColumn("before", F.lag("id").over(W.partitionBy("k").orderBy("ms", "id")))
    got = got.select("k", "ms", "id", "v", F.col("p.id").alias("before"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("size", [1, 2, 3, 10, 999, 3000])
def test_exact_median(spark, size):
    rnd = random.Random(size)
    values = [int(rnd.paretovariate(0.7)) for _ in range(size)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v long, g int")
    assert ordered.exact_median(df, "v").first()["median"] == statistics.median(values)
    for r in ordered.exact_median(df, "v", ["g"]).collect():
        assert r["median"] == statistics.median(values[r["g"] :: 3])


def greedy(times, cooldown):
    fired = []
    for t in sorted(set(times)):
        if not fired or t - fired[-1] >= cooldown:
            fired.append(t)
    return fired


@pytest.mark.parametrize("span,cooldown", [(2000, 7), (200_000, 50), (50, 1000)])
def test_cooldown_equals_the_greedy_walk(spark, span, cooldown):
    rnd = random.Random(span)
    rows = [("r", f"a{min(2, rnd.randrange(9))}", cooldown, rnd.randrange(span), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "rule string, app_id string, cooldown_us long, us long, event_id long")
    got = {}
    for r in alerts.cooled_down(df).collect():
        got.setdefault(r["app_id"], []).append(r["us"])
    want = {a: greedy([r[3] for r in rows if r[1] == a], cooldown) for a in {r[1] for r in rows}}
    assert {a: sorted(t) for a, t in got.items()} == want


def test_nearest_by_size_equals_all_pairs(spark):
    rnd = random.Random(5)
    runs = [(f"r{i:04d}", rnd.choice([0, 7, 7, 7, 100, int(rnd.paretovariate(0.5) * 50)]), rnd.randrange(40)) for i in range(800)]
    wants = [0, 1, 7, 99, 100, 101, 1000, 123456, 10**12] + [rnd.randrange(1, 3000) for _ in range(60)]
    history = spark.createDataFrame(runs, "app_id string, input_bytes long, day int").withColumn(
        "end_time", F.timestamp_millis(F.col("day").cast("long") * 1000)
    )
    requests = spark.createDataFrame([(w,) for w in wants], "input_bytes long")
    found = neighbors.nearest_by_size(requests, history, ["app_id"], k=5, threshold=0.7, buckets=16)
    got = {r["input_bytes"]: [m["app_id"] for m in r["matches"]] for r in found.collect()}

    def score(a, b):
        return 1.0 if a == b == 0 else 0.0 if 0 in (a, b) else min(a, b) / max(a, b)

    for w in set(wants):
        ranked = sorted((-score(w, s), -day, app) for app, s, day in runs if score(w, s) >= 0.7)
        assert got.get(w, []) == [app for _, _, app in ranked[:5]]


def test_replay_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(tuning, "CHUNK", 7)
    rnd = random.Random(11)
    rows = [
        (1, i, rnd.choice(["increase", "decrease", "set", "reset"]), float(rnd.randrange(0, 30)), "integer", 0.0, 40.0, 10.0)
        for i in range(300)
    ]
    df = spark.createDataFrame(
        rows, "c int, ms long, action string, amount double, type string, min_value double, max_value double, default_value double"
    )
    out = tuning.replay(df, ["c"], ["ms"], ordered.block_of("ms", 50)).orderBy("ms").collect()
    value, seen = None, []
    for _, _, action, amount, *_ in rows:
        base = value or 0.0
        step = amount or 1.0
        new = {"increase": base + step, "decrease": base - step, "set": amount, "reset": 10.0}[action]
        seen.append((value, min(40.0, max(0.0, new))))
        value = seen[-1][1]
    assert [(r["old_value"], r["new_value"]) for r in out] == seen


def test_replay_of_a_hot_key(spark):
    n = 300_000
    actions = F.array(*[F.lit(a) for a in ("increase", "decrease", "increase", "set", "increase", "reset", "decrease")])
    rows = spark.range(n).select(
        F.lit(1).alias("c"),
        F.col("id").alias("ms"),
        F.when(F.col("id") % 1009 == 0, "set").otherwise(F.get(actions, F.pmod(F.xxhash64("id"), F.when(F.col("id") % 50 == 0, 7).otherwise(3)).cast("int"))).alias("action"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30)).cast("double").alias("amount"),
        F.lit("integer").alias("type"),
        F.lit(0.0).alias("min_value"),
        F.lit(400.0).alias("max_value"),
        F.lit(10.0).alias("default_value"),
    )
    got = {r.ms: (r.old_value, r.new_value) for r in tuning.replay(rows, ["c"], ["ms"]).collect()}
    value = None
    for r in rows.orderBy("ms").toLocalIterator():
        base, step = value or 0.0, r.amount or 1.0
        new = {"increase": base + step, "decrease": base - step, "set": r.amount, "reset": 10.0}[r.action]
        old, value = value, min(400.0, max(0.0, new))
        assert got[r.ms] == (old, value)
    assert len(got) == n


def test_salted_join_and_join_size(spark, hot):
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3)], "k string, w int")
    plain = hot.join(other, "k")
    salted = workloads.salted_join(hot, other, "k", ["id"], 5)
    assert salted.select(plain.columns).exceptAll(plain).count() == 0 and salted.count() == plain.count()
    sizes = {r["k"]: r["rows"] for r in workloads.join_size(hot, other, "k").collect()}
    assert sum(sizes.values()) == plain.count()


def test_top_similar_in_several_passes(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(f"v{i:03d}", [rnd.random() for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "app_id string, vector array<double>")
    once = neighbors.top_similar(df, df, ["vector"], neighbors.vector_scores(), k=3)
    monkeypatch.setattr(neighbors, "MAX_TARGETS_PER_PASS", 50)
    passes = neighbors.top_similar(df, df, ["vector"], neighbors.vector_scores(), k=3)
    assert passes.exceptAll(once).count() == 0 and passes.count() == 360


@pytest.mark.parametrize("method", ["euclidean", "cosine"])
def test_top_similar_in_blocks_is_all_pairs(spark, monkeypatch, method):
    rng = np.random.default_rng(3)
    vectors = [(rng.integers(1, 40) * rng.random(3)).tolist() for _ in range(90)]
    rows = [(f"v{i:03d}", v) for i, v in enumerate(vectors + vectors[:30])]
    df = spark.createDataFrame(rows, "app_id string, vector array<double>")
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "MAX_TARGETS_PER_PASS", 7)
    monkeypatch.setattr(neighbors, "FEW_MEETINGS", 0)
    got = {(r.target, r.place): (r.candidate, r.score) for r in neighbors.top_similar(df, df, ["vector"], neighbors.vector_scores(method), k=4).collect()}
    m = np.array([v for _, v in rows])
    unit = m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-10)
    for i, (name, v) in enumerate(rows):
        score = 1 / (1 + np.sqrt(((m - np.array(v)) ** 2).sum(axis=1))) if method == "euclidean" else unit @ unit[i]
        best = sorted((-round(float(s), 9), rows[j][0]) for j, s in enumerate(score) if j != i)[:4]
        for place, (s, other) in enumerate(best):
            assert got[name, place + 1] == (other, pytest.approx(-s, abs=2e-9))


def test_weighted_similarity_in_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    columns = neighbors.WEIGHTED_COLUMNS
    rows = []
    for i in range(150):
        row = {c: rnd.choice([None, 0, 1, 5, 100, 10**4, 10**9]) for c in columns}
        row["app_name"] = rnd.choice([None, "daily etl", "daily report", "train"])
        rows.append((f"a{i:03d}", *[row[c] for c in columns]))
    types = ", ".join(f"{c} {'string' if c == 'app_name' else 'bigint'}" for c in columns)
    df = spark.createDataFrame(rows, f"app_id string, {types}")
    once = sorted(map(tuple, neighbors.top_similar(df, df, columns, neighbors.weighted_scores(), k=3).collect()))
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neighbors, "MAX_TARGETS_PER_PASS", 11)
    monkeypatch.setattr(neighbors, "FEW_MEETINGS", 0)
    assert sorted(map(tuple, neighbors.top_similar(df, df, columns, neighbors.weighted_scores(), k=3).collect())) == once
    assert len(once) == 450


def test_blocks_by_two_steps_are_those_of_all_cuts(spark):
    rnd = random.Random(3)
    values = [None] * 5 + [rnd.choice([rnd.gauss(0, 10), float(rnd.randrange(9))]) for _ in range(4000)]
    rows = spark.createDataFrame([("hot" if i % 4 else "few", v) for i, v in enumerate(values)], "k string, v double").cache()
    cuts = rows.groupBy("k").agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 1024).alias("cuts"))
    known = {r["k"]: sorted(set(r["cuts"])) for r in cuts.collect() if r["k"] == "hot"}
    got = ordered.equi_depth(rows, ["k"], "v", whole=2000).collect()
    assert ordered.STRIDE < 256 and len(got) == len(values) and len({r["_depth"] for r in got}) > 100
    for r in got:
        assert r["_depth"] == sum(c < r["v"] for c in known.get(r["k"], []) if r["v"] is not None)
