"""Queries: features, similar runs and recommended configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions import similarity as sim
from jobsight.functions.numeric import half_even
from jobsight.operators import features, learn, neighbors, recommend
from jobsight.operators.ordered import block_of, with_previous
from jobsight.plans.diagnosis import jobs, r
from jobsight.plans.registry import query
from jobsight.session import shared_dir

_G = "1073741824e0"
_FEATURE_SQL = f"""
SELECT app_id, input_bytes / {_G} AS input_size_gb, output_bytes / {_G} AS output_size_gb,
  shuffle_read_bytes / {_G} AS shuffle_size_gb, CAST(num_executors * executor_cores AS DOUBLE) AS total_cores,
  CAST(num_executors * executor_memory_mb AS DOUBLE) / 1024e0 AS total_memory_gb,
  CAST(executor_cores AS DOUBLE) AS executor_cores_feature, CAST(total_stages AS DOUBLE) AS num_stages,
  CAST(total_tasks AS DOUBLE) AS num_tasks, CAST(total_tasks AS DOUBLE) / greatest(total_stages, 1) AS avg_tasks_per_stage,
  CAST(output_bytes AS DOUBLE) / greatest(input_bytes, 1) AS io_ratio,
  CAST(shuffle_read_bytes AS DOUBLE) / greatest(input_bytes, 1) AS shuffle_to_input_ratio FROM jobs"""
_F = features.FEATURES


def featured(name: str, sql: str | None, **extra: str):
    return query(name, sql, {"features": _FEATURE_SQL, **extra})


@featured("rec_01_run_features", f"SELECT app_id, {', '.join(_F)} FROM features")
def _(t):
    return features.with_features(jobs(t))


@featured("rec_02_feature_matrix", f"SELECT app_id, {', '.join(f'{r(c, 5)} AS {c}' for c in _F)} FROM features")
def _(t):
    """The matrix rows as arrays, shown by their places."""
    vector = features.with_features(jobs(t)).select("app_id", F.array(*_F).alias("v"))
    return vector.select("app_id", *[half_even(F.col("v")[i], 5).alias(c) for i, c in enumerate(_F)])


_STATS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, AVG({c}) AS mean, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS std,"
    f" MIN({c}) AS min, CASE WHEN MAX({c}) = MIN({c}) THEN MIN({c}) + 1e0 ELSE MAX({c}) END AS max FROM features"
    for c in _F
)


@featured(
    "agg_11_feature_statistics",
    f"SELECT feature, {r('mean', 5)} AS mean, {r('std', 5)} AS std, {r('min', 5)} AS min, {r('max', 5)} AS max FROM stats",
    stats=_STATS,
)
def _(t):
    stats = features.fit(features.with_features(jobs(t)))
    return stats.select("feature", *[half_even(c, 5).alias(c) for c in ("mean", "std", "min", "max")])


#: Statistics by name; a zero spread counts as one.
_SPREADS = ", ".join(
    f"AVG({c}) AS m_{c}, CASE WHEN MAX({c}) = MIN({c}) THEN 1e0 ELSE stddev_pop({c}) END AS s_{c}, MIN({c}) AS lo_{c},"
    f" CASE WHEN MAX({c}) = MIN({c}) THEN MIN({c}) + 1e0 ELSE MAX({c}) END AS hi_{c}"
    for c in _F
)


def _normalised(name, method, expression, source="features"):
    body = ", ".join(f"{r(expression.format(c=c), 5)} AS {c}" for c in _F)

    @featured(
        name,
        f"SELECT app_id, {body} FROM scaled, (SELECT {_SPREADS} FROM scaled) z",
        scaled=source if source.startswith("SELECT") else f"SELECT * FROM {source}",
    )
    def _(t):
        out = features.fit_transform(features.with_features(jobs(t)), method)
        return out.select("app_id", *[half_even(c, 5).alias(c) for c in _F])


_normalised("rec_03_z_scores", "standard", "({c} - m_{c}) / s_{c}")
_normalised("rec_03_min_max", "minmax", "({c} - lo_{c}) / (hi_{c} - lo_{c})")
_normalised(
    "rec_03_log_z_scores",
    "log",
    "({c} - m_{c}) / s_{c}",
    f"SELECT app_id, {', '.join(f'ln(1 + abs({c})) AS {c}' for c in _F)} FROM features",
)


@featured(
    "rec_04_fit_then_transform",
    f"""SELECT app_id, {", ".join(f"{r(f'({c} - m_{c}) / s_{c}', 5)} AS {c}" for c in _F)} FROM features,
      (SELECT {_SPREADS} FROM features JOIN jobs USING (app_id) WHERE status = 'completed') z""",
)
def _(t):
    """Statistics of the completed runs applied to all runs."""
    fitted = features.fit(features.with_features(jobs(t).filter(F.col("status") == "completed")))
    out = features.transform(features.with_features(jobs(t)), fitted)
    return out.select("app_id", *[half_even(c, 5).alias(c) for c in _F])


_VECTOR = "[" + ", ".join(
    f"CAST({c} AS DOUBLE)" if c == "executor_cores" else f"ln(1 + CAST({c} AS DOUBLE))" for c in sim.VECTOR_COLUMNS
) + "]"


@query(
    "rec_05_run_vector",
    f"SELECT app_id, {', '.join(f'{r(f'v[{i + 1}]')} AS d{i}' for i in range(10))} FROM (SELECT app_id, {_VECTOR} AS v FROM jobs) x",
)
def _(t):
    rows = jobs(t).select("app_id", sim.run_vector().alias("v"))
    return rows.select("app_id", *[half_even(F.col("v")[i], 6).alias(f"d{i}") for i in range(10)])


def _latest_of_name(t):
    """The newest run of every name asks for similar runs."""
    cols = ["app_id", *neighbors.WEIGHTED_COLUMNS, "vector"]
    rows = jobs(t).withColumn("vector", sim.run_vector())
    newest = rows.groupBy("app_name").agg(
        F.max_by(F.struct(*cols), F.struct("start_ms", "app_id")).alias("row")
    )
    return rows, newest.select("row.*")


_TARGETS = """
SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY app_name ORDER BY start_ms DESC, app_id DESC) = 1"""


def _ratio_sql(c):
    return (
        f"CASE WHEN greatest(a.{c}, b.{c}) = 0 THEN 1e0 ELSE CAST(least(a.{c}, b.{c}) AS DOUBLE)"
        f" / greatest(a.{c}, b.{c}) END"
    )


_BIGRAMS = "list_distinct(list_transform(generate_series(1, length({x}) - 1), lambda i: substr({x}, i, 2)))"
_NAME_SIM = f"""CASE WHEN a.app_name = b.app_name THEN 1e0
  WHEN contains(a.app_name, b.app_name) OR contains(b.app_name, a.app_name) THEN 0.8e0
  ELSE CAST(len(list_intersect({_BIGRAMS.format(x='a.app_name')}, {_BIGRAMS.format(x='b.app_name')})) AS DOUBLE)
    / len(list_distinct(list_concat({_BIGRAMS.format(x='a.app_name')}, {_BIGRAMS.format(x='b.app_name')}))) END"""


def _weighted_sql(w):
    parts = [
        (w["input_size"], _ratio_sql("input_bytes")),
        (w["app_name"], "n.s"),
        (w["num_stages"], _ratio_sql("total_stages")),
        (
            w["executor_config"],
            f"(({_ratio_sql('num_executors')} + {_ratio_sql('executor_cores')} + {_ratio_sql('executor_memory_mb')}) / 3)",
        ),
        (w["shuffle_size"], _ratio_sql("shuffle_write_bytes")),
        (w["output_size"], _ratio_sql("output_bytes")),
    ]
    score = " + ".join(f"({s}) * {x!r}::DOUBLE" for x, s in parts)
    total = " + ".join(f"{x!r}::DOUBLE" for x, _ in parts)
    return f"""SELECT target, candidate, score, place FROM (
      SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, candidate) AS place FROM (
        SELECT a.app_id AS target, b.app_id AS candidate, {r(f'({score}) / ({total})', 9)} AS score
        FROM targets a JOIN jobs b ON a.app_id <> b.app_id JOIN name_pairs n ON n.x = a.app_name AND n.y = b.app_name) p) q
    WHERE place <= 5"""


_NAME_PAIRS = f"""
SELECT a.app_name AS x, b.app_name AS y, {_NAME_SIM} AS s
FROM (SELECT DISTINCT app_name FROM jobs) a, (SELECT DISTINCT app_name FROM jobs) b"""
_PAIR_CTES = {"targets": _TARGETS, "name_pairs": _NAME_PAIRS}


@query("rec_07_top_weighted_similarity", _weighted_sql(sim.DEFAULT_WEIGHTS), _PAIR_CTES)
def _(t):
    rows, targets = _latest_of_name(t)
    return neighbors.top_similar(rows, targets, neighbors.WEIGHTED_COLUMNS, neighbors.weighted_scores())


_OTHER = {"input_size": 0.1, "app_name": 0.4, "num_stages": 0.1, "executor_config": 0.2, "shuffle_size": 0.1, "output_size": 0.1}


@query("udx_04_custom_weights", _weighted_sql(_OTHER), _PAIR_CTES)
def _(t):
    rows, targets = _latest_of_name(t)
    return neighbors.top_similar(rows, targets, neighbors.WEIGHTED_COLUMNS, neighbors.weighted_scores(_OTHER))


def _vector_sql(targets, candidates, key, score):
    return f"""SELECT target, candidate, score, place FROM (
      SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, candidate) AS place FROM (
        SELECT a.{key} AS target, b.{key} AS candidate, {r(score, 9)} AS score
        FROM {targets} a JOIN {candidates} b ON a.{key} <> b.{key}) p) q WHERE place <= 5"""


_VECTORS = {"targets": _TARGETS, "vectors": f"SELECT app_id, {_VECTOR} AS v FROM jobs",
            "target_vectors": f"SELECT app_id, {_VECTOR} AS v FROM targets"}


@query(
    "rec_06_top_cosine",
    _vector_sql("target_vectors", "vectors", "app_id", "list_cosine_similarity(a.v, b.v)"),
    _VECTORS,
)
def _(t):
    rows, targets = _latest_of_name(t)
    return neighbors.top_similar(rows, targets, ["vector"], neighbors.vector_scores("cosine"))


@query(
    "rec_06_top_euclidean",
    _vector_sql("target_vectors", "vectors", "app_id", "1 / (1 + list_distance(a.v, b.v))"),
    _VECTORS,
)
def _(t):
    rows, targets = _latest_of_name(t)
    return neighbors.top_similar(rows, targets, ["vector"], neighbors.vector_scores("euclidean"))


_EMBEDDED = {
    "vectors": "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings",
    "firsts": "SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1",
}


def _embeddings(t):
    rows = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    first = rows.groupBy("label").agg(F.min_by(F.struct("vec_id", "vector"), "vec_id").alias("r")).select("r.*")
    return rows, first


@query(
    "rec_06_top_cosine_embeddings",
    _vector_sql(
        "firsts",
        "vectors",
        "vec_id",
        "list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-10)"
        " * (sqrt(list_inner_product(b.v, b.v)) + 1e-10))",
    ),
    _EMBEDDED,
)
def _(t):
    rows, first = _embeddings(t)
    return neighbors.top_similar(rows, first, ["vector"], neighbors.vector_scores("cosine"), key="vec_id")


@query(
    "sca_13_cosine_to_label_mean",
    f"""SELECT vec_id, {r('list_cosine_similarity(v, m)')} AS cosine, {r('list_distance(v, m)')} AS distance
    FROM vectors JOIN (SELECT label, list(c ORDER BY i) AS m FROM (
      SELECT label, i, AVG(v[i]) AS c FROM (SELECT label, v, unnest(generate_series(1, len(v))) AS i FROM vectors) u
      GROUP BY label, i) g GROUP BY label) c USING (label)""",
    _EMBEDDED,
)
def _(t):
    """Cosine and distance of every vector to the mean of its label; the means are one row per label."""
    rows, _first = _embeddings(t)
    parts = rows.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean")
    )
    joined = rows.join(means, "label")
    return joined.select(
        "vec_id",
        half_even(sim.cosine(F.col("vector"), F.col("mean")), 6).alias("cosine"),
        half_even(sim.euclidean(F.col("vector"), F.col("mean")), 6).alias("distance"),
    )


@query(
    "sca_11_consecutive_similarity",
    f"""SELECT b.app_id, {r('''((''' + _ratio_sql('input_bytes') + ''') * 0.3e0 + (''' + _NAME_SIM + ''') * 0.2e0) / (0.3e0 + 0.2e0)''')} AS similarity
    FROM (SELECT *, lag(input_bytes) OVER w AS p_input, lag(app_name) OVER w AS p_name FROM jobs
      WINDOW w AS (PARTITION BY user_name ORDER BY start_ms, app_id)) b,
    LATERAL (SELECT b.p_input AS input_bytes, b.p_name AS app_name) a WHERE b.p_name IS NOT NULL""",
)
def _(t):
    """Similarity of a run to the run before it of the same user, over the dimensions both are asked for."""
    rows = jobs(t)
    paired = with_previous(
        rows, ["user_name"], block_of("start_ms"), ["start_ms", "app_id"], ["input_bytes", "app_name"], "before"
    ).filter(F.col("before").isNotNull())
    blank = [F.lit(None).cast("long").alias(c) for c in (
        "total_stages", "num_executors", "executor_cores", "executor_memory_mb", "shuffle_write_bytes", "output_bytes")]
    pair = paired.select(
        "app_id", F.struct("before.*", *blank).alias("a"), F.struct("input_bytes", "app_name", *blank).alias("b")
    )
    return pair.select("app_id", half_even(sim.weighted_similarity("a", "b"), 6).alias("similarity"))


@query(
    "set_02_shared_name_bigrams",
    f"""SELECT b.app_id, CAST(len(list_intersect({_BIGRAMS.format(x='a.user_name')}, {_BIGRAMS.format(x='b.app_name')})) AS BIGINT) AS shared,
      CAST(len(list_distinct(list_concat({_BIGRAMS.format(x='a.user_name')}, {_BIGRAMS.format(x='b.app_name')}))) AS BIGINT) AS together
    FROM (SELECT app_id, lower(user_name) AS user_name FROM order_info) a JOIN order_info b USING (app_id)""",
)
def _(t):
    user, name = sim.bigrams(F.lower("user_name")), sim.bigrams(F.lower("app_name"))
    return t.orders.select(
        "app_id",
        F.size(F.array_intersect(user, name)).cast("long").alias("shared"),
        F.size(F.array_union(user, name)).cast("long").alias("together"),
    )


_PAST = """
SELECT * FROM jobs j JOIN (SELECT app_id FROM applications WHERE failed_tasks = 0 AND end_ms IS NOT NULL) f USING (app_id)"""
_MATCHES = f"""
SELECT input_bytes, list(m ORDER BY place) AS ms FROM (
  SELECT q.input_bytes, h.place, {{'app_id': h.app_id, 'c': h.executor_cores, 'm': h.executor_memory_mb, 'n': h.num_executors,
    'd': h.driver_memory_mb, 'score': h.score, 'w': CASE WHEN h.disk_spilled_bytes + h.memory_spilled_bytes > 0 THEN 0.7e0 ELSE 1e0 END
      * CASE WHEN h.tp > 0 THEN least(2e0, 1e0 + h.tp / 1000000e0) ELSE 1e0 END}} AS m
  FROM (SELECT DISTINCT input_bytes FROM requests) q JOIN (
    SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY score DESC, end_ms DESC, app_id) AS place FROM (
      SELECT p.*, q.input_bytes AS wanted, CASE WHEN p.duration_ms > 0 THEN CAST(p.input_bytes AS DOUBLE) / p.duration_ms ELSE 0e0 END AS tp,
        CASE WHEN greatest(q.input_bytes, p.input_bytes) = 0 THEN 1e0
          ELSE CAST(least(q.input_bytes, p.input_bytes) AS DOUBLE) / greatest(q.input_bytes, p.input_bytes) END AS score
      FROM (SELECT DISTINCT input_bytes FROM requests) q JOIN past p
        ON p.input_bytes >= q.input_bytes * 0.69e0 AND p.input_bytes <= q.input_bytes / 0.69e0) s
    WHERE score >= 0.7e0) h ON h.wanted = q.input_bytes WHERE h.place <= 5) x GROUP BY input_bytes"""


def _fold(expr):
    return f"list_reduce(list_transform(ms, lambda m: {expr}), lambda a, b: a + b)"


_WEIGHTED = f"""
SELECT input_bytes, len(ms) AS n, list_transform(ms, lambda m: m.app_id) AS ids,
  greatest(1, CAST(round_even({_fold('m.c * (m.w / total)')}, 0) AS BIGINT)) AS executor_cores,
  greatest(1024, CAST(round_even({_fold('m.m * (m.w / total)')} / 1024e0, 0) * 1024 AS BIGINT)) AS executor_memory_mb,
  greatest(1, CAST(round_even({_fold('m.n * (m.w / total)')}, 0) AS BIGINT)) AS num_executors,
  greatest(1024, CAST(round_even({_fold('m.d * (m.w / total)')} / 1024e0, 0) * 1024 AS BIGINT)) AS driver_memory_mb
FROM (SELECT *, {_fold('m.w')} AS total FROM matches) x"""
_BASELINE = f"""
SELECT *, greatest(2048, CAST(round_even(memory3 / 1024e0, 0) * 1024 AS BIGINT)) AS b_memory,
  CASE WHEN job_type = 'ml' THEN 6144 ELSE 4096 END AS b_driver, CASE WHEN priority = 'performance' THEN 6 ELSE 4 END AS b_cores,
  executors3 AS b_executors
FROM (SELECT *, CASE priority WHEN 'performance' THEN CAST(floor(executors2 * 1.2e0) AS BIGINT)
      WHEN 'cost' THEN greatest(2, CAST(floor(executors2 * 0.8e0) AS BIGINT)) ELSE executors2 END AS executors3,
    CASE priority WHEN 'performance' THEN CAST(floor(memory2 * 1.2e0) AS BIGINT)
      WHEN 'cost' THEN CAST(floor(memory2 * 0.8e0) AS BIGINT) ELSE memory2 END AS memory3
  FROM (SELECT *, CASE WHEN job_type = 'streaming' THEN CAST(floor(executors1 * 1.3e0) AS BIGINT) ELSE executors1 END AS executors2,
      CASE WHEN job_type = 'ml' THEN CAST(floor(memory1 * 1.5e0) AS BIGINT)
        WHEN job_type = 'streaming' THEN CAST(floor(memory1 * 0.8e0) AS BIGINT) ELSE memory1 END AS memory2
    FROM (SELECT *, greatest(2, CAST(floor(5 * scale) AS BIGINT)) AS executors1,
        CAST(floor(8192 * least(2e0, 1e0 + scale / 10e0)) AS BIGINT) AS memory1
      FROM (SELECT *, greatest(0.5e0, least(5e0, input_bytes / {_G} / 10e0)) AS scale FROM requests) a) b) c) d"""
_MATCH_CTES = {"past": _PAST, "matches": _MATCHES, "weighted": _WEIGHTED, "base_config": _BASELINE}


def matched(name: str, sql: str | None):
    return query(name, sql, _MATCH_CTES)


def _past(t):
    return recommend.history(t.apps)


@matched(
    "rec_08_history_selection",
    "SELECT app_id, duration_ms, input_bytes FROM past ORDER BY end_ms DESC, app_id LIMIT 1000",
)
def _(t):
    return recommend.history(t.apps, limit=1000).select("app_id", "duration_ms", "input_bytes")


@matched(
    "join_04_nearest_runs",
    f"""SELECT input_bytes, m.app_id AS app_id, {r('m.score', 9)} AS score FROM (SELECT input_bytes, unnest(ms) AS m FROM matches) x""",
)
def _(t):
    found = recommend.matches_for(t.requests, _past(t))
    return found.select("input_bytes", F.explode("matches").alias("m")).select(
        "input_bytes", "m.app_id", half_even("m.score", 9).alias("score")
    )


@matched(
    "win_03_top_matches_per_request",
    """SELECT request_id, u.app_id AS app_id, u.place AS place FROM requests JOIN matches USING (input_bytes),
      LATERAL (SELECT unnest(ids) AS app_id, unnest(generate_series(1, len(ids))) AS place
        FROM (SELECT list_transform(ms, lambda m: m.app_id) AS ids) i) u""",
)
def _(t):
    found = recommend.matches_for(t.requests, _past(t))
    rows = t.requests.join(found, "input_bytes").select("request_id", F.posexplode("matches").alias("place", "m"))
    return rows.select("request_id", "m.app_id", (F.col("place") + 1).cast("long").alias("place"))


_SETTINGS = ", ".join(recommend.SETTINGS)


@matched(
    "agg_10_weighted_mean_config",
    f"SELECT input_bytes, {_SETTINGS} FROM weighted",
)
def _(t):
    found = recommend.matches_for(t.requests, _past(t))
    mean = recommend.weighted_config(F.col("matches"))
    return found.select("input_bytes", *[mean[c].alias(c) for c in recommend.SETTINGS])


_BY_SIMILARITY = """SELECT request_id, coalesce(w.executor_cores, b_cores) AS executor_cores,
  coalesce(w.executor_memory_mb, b_memory) AS executor_memory_mb, coalesce(w.num_executors, b_executors) AS num_executors,
  coalesce(w.driver_memory_mb, b_driver) AS driver_memory_mb, CASE WHEN w.n IS NULL THEN 0.5e0 ELSE 0.8e0 END AS confidence,
  CASE WHEN w.n IS NULL THEN 'fallback' ELSE 'similarity' END AS method, coalesce(w.n, 0) AS similar_jobs_count
FROM base_config LEFT JOIN weighted w USING (input_bytes)"""


@matched("rec_09_similarity_recommendation", _BY_SIMILARITY)
def _(t):
    out = recommend.by_similarity(t.requests, _past(t))
    return out.drop("similar_jobs")


@matched(
    "rec_10_fallback",
    f"""SELECT request_id, CAST(b_cores AS BIGINT) AS executor_cores, b_memory AS executor_memory_mb,
      b_executors AS num_executors, CAST(b_driver AS BIGINT) AS driver_memory_mb, 0.5e0 AS confidence,
      {r(f'input_bytes / {_G}', 2)} AS input_gb FROM base_config""",
)
def _(t):
    return recommend.fallback(t.requests)


@matched(
    "rec_11_baseline_config",
    "SELECT request_id, CAST(b_cores AS BIGINT) AS executor_cores, b_executors AS num_executors FROM base_config",
)
def _(t):
    base = recommend.baseline(F.col("input_bytes"), F.col("job_type"), F.col("priority"))
    return t.requests.select(
        "request_id", base["executor_cores"].alias("executor_cores"), base["num_executors"].alias("num_executors")
    )


_RULE_BASED = f"""SELECT *, CASE WHEN input_bytes / {_G} > 100 THEN least(b_executors * b_cores * 4, 2000)
    WHEN input_bytes / {_G} > 10 THEN b_executors * b_cores * 2 ELSE greatest(b_executors * b_cores, 20) END AS parts
  FROM base_config"""


@matched(
    "rec_12_rule_recommendation",
    f"""SELECT request_id, CAST(b_cores AS BIGINT) AS executor_cores, b_memory AS executor_memory_mb,
      b_executors AS num_executors, CAST(b_driver AS BIGINT) AS driver_memory_mb, 0.7e0 AS confidence,
      'rule_based' AS method, CAST(abs(parts - 200) > 50 AS BIGINT) AS rules_applied,
      CASE WHEN abs(parts - 200) > 50 THEN 'PARTITION001' ELSE '' END AS optimization_hints FROM ({_RULE_BASED}) x""",
)
def _(t):
    rows = recommend.rule_based(t.requests)
    return rows.withColumn("optimization_hints", F.array_join("optimization_hints", ","))


@matched(
    "rec_22_method_comparison",
    f"""SELECT s.request_id, s.num_executors AS matched_executors, b_executors AS rule_executors,
      s.executor_memory_mb AS matched_memory, b_memory AS rule_memory FROM ({_BY_SIMILARITY}) s
    JOIN base_config USING (request_id)""",
)
def _(t):
    both = recommend.compare_methods(
        recommend.by_similarity(t.requests, _past(t)).withColumn("method", F.lit("matched")),
        recommend.rule_based(t.requests).withColumn("method", F.lit("rule")),
    )
    pivoted = both.groupBy("request_id").pivot("method", ["matched", "rule"])
    wide = pivoted.agg(F.max("num_executors").alias("executors"), F.max("executor_memory_mb").alias("memory"))
    return wide


@matched(
    "cost_25_budget_check",
    f"""SELECT request_id, {r('cost', 4)} AS cost, cost <= 2.5e0 AS within_budget,
      CASE WHEN cost > 2.5e0 THEN {r('cost - 2.5e0', 4)} ELSE 0e0 END AS over_by
    FROM (SELECT *, b_executors * 1e0 * (0.1e0 * (b_memory / 1024e0 / 4e0)) AS cost FROM base_config) x""",
)
def _(t):
    """Every request has its priority; one hour of run time is assumed."""
    rows = recommend.fallback(t.requests)
    cost = recommend.executor_hour_cost(F.col("num_executors"), F.col("executor_memory_mb"), F.lit(1.0))
    return rows.select(
        "request_id",
        half_even(cost, 4).alias("cost"),
        (cost <= 2.5).alias("within_budget"),
        F.when(cost > 2.5, half_even(cost - 2.5, 4)).otherwise(0.0).alias("over_by"),
    )


@matched(
    "doc_01_hybrid_recommendation",
    f"""SELECT request_id, CASE WHEN s.method = 'similarity'
        THEN CAST(round_even(CAST(s.num_executors * 80 + b_executors * 50 AS DOUBLE) / 130, 0) AS BIGINT) ELSE b_executors END AS num_executors,
      CASE WHEN s.method = 'similarity'
        THEN CAST(round_even(CAST(s.executor_memory_mb * 80 + b_memory * 50 AS DOUBLE) / 130, 0) AS BIGINT) ELSE b_memory END AS executor_memory_mb,
      CASE WHEN s.method = 'similarity' THEN 2 ELSE 1 END AS methods
    FROM ({_BY_SIMILARITY}) s JOIN base_config USING (request_id)""",
)
def _(t):
    columns = ["request_id", "method", "confidence", *recommend.SETTINGS]
    answers = recommend.by_similarity(t.requests, _past(t)).select(*columns).unionByName(
        recommend.rule_based(t.requests).select(*columns)
    )
    out = recommend.hybrid(answers)
    return out.select("request_id", "num_executors", "executor_memory_mb", "methods")


@matched(
    "doc_02_size_category",
    f"""SELECT request_id, category, greatest(1, CAST(floor(e * CASE job_type WHEN 'ml' THEN 0.8e0 WHEN 'streaming' THEN 1.2e0 ELSE 1e0 END) AS BIGINT)) AS num_executors,
      CAST(c AS BIGINT) AS executor_cores,
      CAST(floor(m * CASE job_type WHEN 'ml' THEN 1.5e0 WHEN 'sql' THEN 1.2e0 WHEN 'streaming' THEN 1.3e0 ELSE 1e0 END) AS BIGINT) AS executor_memory_mb
    FROM requests, LATERAL (SELECT * FROM (VALUES (10e0, 'small', 5, 2, 4096), (100e0, 'medium', 10, 4, 8192),
        (1000e0, 'large', 20, 4, 16384), (1e30, 'xlarge', 50, 4, 16384)) v(bound, category, e, c, m)
      WHERE input_bytes / {_G} <= bound ORDER BY bound LIMIT 1) k""",
)
def _(t):
    return recommend.by_category(t.requests)


@matched(
    "doc_03_documented_confidence",
    """SELECT request_id, round_even((CASE WHEN coalesce(m.best, 0e0) < 0.7e0 THEN 0.7e0 ELSE 1e0 END
      * CASE WHEN input_bytes > (SELECT MAX(input_bytes) FROM past) THEN 0.8e0 ELSE 1e0 END) * 10000, 0) / 10000 AS confidence
    FROM requests LEFT JOIN (SELECT input_bytes, ms[1].score AS best FROM matches) m USING (input_bytes)""",
)
def _(t):
    past = _past(t)
    found = recommend.matches_for(t.requests, past).select("input_bytes", F.col("matches")[0]["score"].alias("best"))
    known = past.agg(F.struct(F.count(F.lit(1)).alias("runs"), F.max("input_bytes").alias("largest")).alias("known"))
    rows = t.requests.join(found, "input_bytes", "left").withColumn("known", known.scalar())
    value = recommend.documented_confidence(
        F.col("known.runs"), F.coalesce("best", F.lit(0.0)), F.col("input_bytes") > F.col("known.largest")
    )
    return rows.select("request_id", half_even(value, 4).alias("confidence"))


@matched(
    "doc_04_executors_within_budget",
    """SELECT request_id, CASE WHEN b_executors * u <= 1e0 THEN b_executors
      ELSE greatest(least(CAST(floor(1e0 / u) AS BIGINT), b_executors - 1), least(b_executors - 1, 1)) END AS num_executors
    FROM (SELECT *, 0.1e0 * (b_memory / 1024e0 / 4e0) AS u FROM base_config) x""",
)
def _(t):
    rows = recommend.fallback(t.requests)
    unit = 0.10 * (F.col("executor_memory_mb") / 1024.0 / 4.0)
    return rows.select(
        "request_id", recommend.executors_within(F.lit(1.0), unit, F.col("num_executors")).alias("num_executors")
    )


@matched(
    "doc_05_config_errors",
    """SELECT request_id, CAST(b_executors < 1 AS BIGINT) + CAST(b_memory < 1024 AS BIGINT)
      + CAST(CAST(b_memory AS DOUBLE) / b_cores < 1024 AS BIGINT) + CAST(b_executors * b_cores > 60 AS BIGINT) AS errors
    FROM base_config""",
)
def _(t):
    rows = recommend.fallback(t.requests)
    return rows.select("request_id", F.size(recommend.config_errors(60)).cast("long").alias("errors"))


# Learned -------------------------------------------------------------------


_KINDS = ["etl", "ml", "streaming", "batch"]
_ONE_HOT = ", ".join(
    [
        *(f"CASE WHEN job_type = '{k}' THEN 1e0 ELSE 0e0 END AS job_type_{k}" for k in _KINDS),
        f"CASE WHEN job_type NOT IN ({', '.join(repr(k) for k in _KINDS)}) THEN 1e0 ELSE 0e0 END AS job_type_other",
        *(f"CASE WHEN priority = '{g}' THEN 1e0 ELSE 0e0 END AS priority_{g}" for g in ("performance", "cost", "balanced")),
    ]
)


@query(
    "rec_13_learning_features",
    f"""SELECT app_id, input_bytes / {_G} AS input_size_gb, output_bytes / {_G} AS output_size_gb,
      (shuffle_read_bytes + shuffle_write_bytes) / {_G} AS shuffle_size_gb,
      CAST(coalesce(nullif(total_stages, 0), 1) AS DOUBLE) AS num_stages, CAST(total_tasks AS DOUBLE) AS num_tasks,
      CAST(total_tasks AS DOUBLE) / greatest(total_stages, 1) AS avg_tasks_per_stage,
      CAST(output_bytes AS DOUBLE) / greatest(input_bytes, 1) AS io_ratio,
      CAST(shuffle_read_bytes + shuffle_write_bytes AS DOUBLE) / greatest(input_bytes, 1) AS shuffle_to_input_ratio,
      {_ONE_HOT} FROM jobs""",
)
def _(t):
    return jobs(t).select("app_id", *[made.alias(name) for name, made in learn.run_features().items()])


@query(
    "rec_14_request_features",
    f"""SELECT request_id, {r('gb')} AS input_size_gb, {r('output')} AS output_size_gb, {r('shuffle')} AS shuffle_size_gb,
      stages AS num_stages, tasks AS num_tasks, {r('tasks / stages')} AS avg_tasks_per_stage,
      {r('output / greatest(gb, 0.001e0)')} AS io_ratio, {r('shuffle / greatest(gb, 0.001e0)')} AS shuffle_to_input_ratio,
      {_ONE_HOT}
    FROM (SELECT *, gb * CASE job_type WHEN 'etl' THEN 0.8e0 WHEN 'ml' THEN 0.1e0 ELSE 0.5e0 END AS output,
        gb * CASE job_type WHEN 'ml' THEN 0.5e0 WHEN 'streaming' THEN 0.2e0 ELSE 0.3e0 END AS shuffle,
        greatest(1e0, floor(log2(gb + 1) * 3)) AS stages, greatest(1e0, floor(gb * 10)) AS tasks
      FROM (SELECT *, input_bytes / {_G} AS gb FROM requests) x) y""",
)
def _(t):
    measured = ["input_size_gb", "output_size_gb", "shuffle_size_gb", "avg_tasks_per_stage", "io_ratio", "shuffle_to_input_ratio"]
    made = {k: half_even(v, 6) if k in measured else v for k, v in learn.request_features().items()}
    return t.requests.select("request_id", *[v.alias(k) for k, v in made.items()])


@query(
    "sca_12_weight_importance",
    f"""SELECT app_name, {r('input / total')} AS input_size, {r('output / total')} AS output_size, {r('shuffle / total')} AS shuffle_size
    FROM (SELECT *, greatest(input + output + shuffle, 1) AS total FROM (SELECT app_name,
      COUNT(*) FILTER (input_bytes > 0) AS input, COUNT(*) FILTER (output_bytes > 1073741824) AS output,
      COUNT(*) FILTER (shuffle_write_bytes > 1073741824) AS shuffle FROM jobs GROUP BY app_name) a) b""",
)
def _(t):
    """Weights of the sizes by how often they matter for the runs of a name, normalised to importances."""
    large = F.lit(1024**3)
    weights = {
        "input_size": F.count_if(F.col("input_bytes") > 0),
        "output_size": F.count_if(F.col("output_bytes") > large),
        "shuffle_size": F.count_if(F.col("shuffle_write_bytes") > large),
    }
    counted = jobs(t).groupBy("app_name").agg(*[w.alias(k) for k, w in weights.items()])
    shares = sim.importance({k: F.col(k) for k in weights})
    return counted.select("app_name", *[half_even(v, 6).alias(k) for k, v in shares.items()])


#: Folders of the models trained by this process, by application, input, kind and folds.
_TRAINED: dict[tuple[str, str, str, int], str] = {}


def _learned(t, kind="random_forest", folds=0):
    """The models at the operator's own size, trained once, saved to the shared folder and loaded from there.

    Folds are fitted only where cross-validation is shown; the models and their metrics on held-out runs do not depend on
    them, so models with folds serve all.
    """
    app = t.spark.sparkContext.applicationId
    found = [path for (a, sf, k, f), path in _TRAINED.items() if (a, sf, k) == (app, t.sf_dir, kind) and f >= folds]
    if not found:
        found = [shared_dir(t.spark, "models")]
        learn.save(learn.train(t.apps, kind=kind, folds=folds), found[0])
        _TRAINED[app, t.sf_dir, kind, folds] = found[0]
    return learn.load(t.spark, found[0])


@query("rec_15_training_metrics")
def _(t):
    """Quality of the four forests on held-out runs and in cross-validation."""
    metrics = _learned(t, folds=5).metrics
    rows = [(target, name, float(value)) for target, m in metrics.items() for name, value in m.items() if name != "samples"]
    return t.spark.createDataFrame(rows, "target string, metric string, value double")


@query("rec_16_boosted_predictions")
def _(t):
    learned = _learned(t, kind="gradient_boosting")
    rows = learn.predict(learned, t.requests, learn.request_features())
    return rows.select("request_id", *[f"predicted_{x}" for x in learn.TARGETS])


@query("rec_17_constrained_predictions")
def _(t):
    rows = learn.apply_constraints(learn.predict(_learned(t), t.requests, learn.request_features()))
    return rows.select("request_id", "priority", *[f"predicted_{x}" for x in learn.TARGETS])


@query("rec_18_prediction_confidence")
def _(t):
    learned = _learned(t)
    rows = learn.predict(learned, t.requests, learn.request_features())
    return rows.select("request_id", learn.confidence(learned).alias("confidence"))


@query("rec_19_feature_importance")
def _(t):
    return learn.importance_rows(t.spark, _learned(t))


@query("rec_20_learned_recommendation")
def _(t):
    return learn.recommend(_learned(t), t.requests)


@query("top_06_top_feature_importance")
def _(t):
    return learn.top_importance(learn.importance_rows(t.spark, _learned(t)))


@query("agg_12_regression_quality")
def _(t):
    """Metrics of the models on all usable runs."""
    quality = learn.evaluate(_learned(t), t.apps)
    rows = [(target, name, float(value)) for target, m in quality.items() for name, value in m.items()]
    return t.spark.createDataFrame(rows, "target string, metric string, value double")


@query("snk_09_model_round_trip")
def _(t):
    """Predictions of the models after saving and loading them."""
    path = shared_dir(t.spark, "models")
    learn.save(_learned(t), path)
    return learn.recommend(learn.load(t.spark, path), t.requests)

