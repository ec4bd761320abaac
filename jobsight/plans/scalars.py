"""Queries: the scalar expressions that have no job of their own, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions import similarity as sim
from jobsight.functions import units
from jobsight.functions.numeric import half_even
from jobsight.operators import cost
from jobsight.operators.ordered import block_of, with_previous
from jobsight.plans.costs import COST_SQL
from jobsight.plans.diagnosis import jobs, r
from jobsight.plans.recommending import _NAME_SIM, _ratio_sql
from jobsight.plans.registry import query



def _memory_text():
    n = F.col("executor_memory_mb").cast("string")
    return (
        F.when(F.col("app_key") % 5 == 0, F.concat(n, F.lit("k")))
        .when(F.col("app_key") % 5 == 1, F.concat(F.lit(" "), n, F.lit("M")))
        .when(F.col("app_key") % 5 == 2, F.concat(n, F.lit("g")))
        .when(F.col("app_key") % 5 == 3, F.lit("1.5t"))
        .otherwise(n)
    )


@query(
    "sca_01_memory_bytes",
    """SELECT app_key, CASE app_key % 5 WHEN 0 THEN executor_memory_mb * 1024 WHEN 1 THEN executor_memory_mb * 1048576
      WHEN 2 THEN executor_memory_mb * 1073741824 WHEN 3 THEN 1649267441664 ELSE executor_memory_mb END AS bytes FROM order_info""",
)
def _(t):
    return t.orders.select("app_key", units.memory_bytes(_memory_text()).alias("bytes"))


@query(
    "sca_02_memory_mb_bare_bytes",
    """SELECT app_key, CASE app_key % 5 WHEN 0 THEN executor_memory_mb // 1024 WHEN 1 THEN executor_memory_mb
      WHEN 2 THEN executor_memory_mb * 1024 WHEN 3 THEN 1572864 ELSE 0 END AS mb,
      CASE WHEN status = 'failed' THEN 1024 ELSE executor_memory_mb END AS or_default FROM order_info""",
)
def _(t):
    maybe = F.when(F.col("status") != "failed", F.concat(F.col("executor_memory_mb").cast("string"), F.lit("m")))
    return t.orders.select(
        "app_key",
        units.memory_mb(_memory_text(), bare_unit="bytes", empty_mb=1024).alias("mb"),
        units.memory_mb(maybe, bare_unit="bytes", empty_mb=1024).alias("or_default"),
    )


@query(
    "sca_03_memory_mb_bare_mb",
    """SELECT app_key, CASE app_key % 5 WHEN 0 THEN executor_memory_mb // 1024 WHEN 1 THEN executor_memory_mb
      WHEN 2 THEN executor_memory_mb * 1024 WHEN 3 THEN 1572864 ELSE executor_memory_mb END AS mb FROM order_info""",
)
def _(t):
    return t.orders.select("app_key", units.memory_mb(_memory_text()).alias("mb"))


@query(
    "sca_05_epoch_or_iso",
    "SELECT app_key, CASE WHEN status = 'running' THEN NULL ELSE start_ms END AS start_ms FROM order_info",
)
def _(t):
    """Finished runs carry epoch times, failed ones ISO text, running ones neither."""
    epoch = F.when(F.col("status") == "completed", F.col("start_ms"))
    iso = F.when(
        F.col("status") == "failed",
        F.concat(F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("GMT")),
    ).when(F.col("status") == "running", F.lit("not a time"))
    return t.orders.select("app_key", F.unix_millis(units.epoch_or_iso(epoch, iso)).alias("start_ms"))


@query("sca_06_job_signature", "SELECT job_signature, COUNT(*) AS given FROM recommendations GROUP BY job_signature")
def _(t):
    return t.recommendations.groupBy("job_signature").agg(F.count(F.lit(1)).alias("given"))


_PAIRS = """
SELECT b.*, lag(input_bytes) OVER w AS p_input, lag(total_stages) OVER w AS p_stages, lag(num_executors) OVER w AS p_n,
  lag(executor_cores) OVER w AS p_c, lag(executor_memory_mb) OVER w AS p_m, lag(app_name) OVER w AS p_name
FROM jobs b WINDOW w AS (PARTITION BY user_name ORDER BY start_ms, app_id)"""
_BEFORE = """LATERAL (SELECT b.p_input AS input_bytes, b.p_stages AS total_stages, b.p_n AS num_executors, b.p_c AS executor_cores,
  b.p_m AS executor_memory_mb, b.p_name AS app_name) a"""
_FIELDS = ["input_bytes", "total_stages", "num_executors", "executor_cores", "executor_memory_mb", "app_name"]


def _pairs(t):
    """Every run beside the one before it of the same user."""
    order = ["start_ms", "app_id"]
    paired = with_previous(jobs(t), ["user_name"], block_of("start_ms", 30 * 86_400_000), order, _FIELDS, "a")
    return paired.filter(F.col("a").isNotNull()).select("app_id", "a", F.struct(*_FIELDS).alias("b"))


@query(
    "sca_07_size_and_count_similarity",
    f"SELECT app_id, {r(_ratio_sql('input_bytes'))} AS size_similarity, {r(_ratio_sql('total_stages'))} AS count_similarity"
    f" FROM pairs b, {_BEFORE} WHERE p_input IS NOT NULL",
    {"pairs": _PAIRS},
)
def _(t):
    both = lambda c: sim.magnitude_similarity(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return _pairs(t).select(
        "app_id",
        half_even(both("input_bytes"), 6).alias("size_similarity"),
        half_even(both("total_stages"), 6).alias("count_similarity"),
    )


@query(
    "sca_09_name_similarity",
    f"SELECT app_id, {r(_NAME_SIM)} AS similarity FROM pairs b, {_BEFORE} WHERE p_input IS NOT NULL",
    {"pairs": _PAIRS},
)
def _(t):
    return _pairs(t).select(
        "app_id", half_even(sim.name_similarity(F.col("a.app_name"), F.col("b.app_name")), 6).alias("similarity")
    )


@query(
    "sca_10_config_similarity",
    f"""SELECT app_id, {r('(' + _ratio_sql('num_executors') + ' + ' + _ratio_sql('executor_cores') + ' + '
        + _ratio_sql('executor_memory_mb') + ') / 3')} AS similarity FROM pairs b, {_BEFORE} WHERE p_input IS NOT NULL""",
    {"pairs": _PAIRS},
)
def _(t):
    return _pairs(t).select("app_id", half_even(sim.config_similarity("a", "b"), 6).alias("similarity"))


@query(
    "sca_22_unit_prices",
    f"""SELECT app_id, {r('hourly_price / vcpus')} AS per_vcpu, {r('hourly_price / memory_gb')} AS per_gb FROM fits
    QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY hourly_price, position) = 1""",
    COST_SQL,
)
def _(t):
    """Unit prices of the cheapest instance every run fits on."""
    fits = cost.matching_instances(F.col("executor_cores"), F.col("executor_memory_mb") / 1024.0)
    best = jobs(t).select("app_id", cost.first_or_null(fits).alias("i")).filter(F.col("i").isNotNull())
    unit = lambda by: half_even(F.try_divide(F.col("i.hourly_price"), F.col(f"i.{by}").cast("double")), 6)
    return best.select("app_id", unit("vcpus").alias("per_vcpu"), unit("memory_gb").alias("per_gb"))


@query(
    "sca_26_display_texts",
    """SELECT app_id, CAST(duration_ms // 60000 AS VARCHAR) || 'm ' || CAST(duration_ms % 60000 // 1000 AS VARCHAR) || 's' AS took,
      CAST(input_bytes // 1073741824 AS VARCHAR) AS whole_gb FROM jobs""",
)
def _(t):
    """The decimals of the size text follow Java rounding, so only its whole part is compared."""
    text = units.gigabytes_text(F.floor(F.col("input_bytes") / 1024**3) * 1024**3)
    return jobs(t).select(
        "app_id",
        units.minutes_seconds(F.col("duration_ms")).alias("took"),
        F.regexp_extract(text, r"^(\d+)\.00 GB$", 1).alias("whole_gb"),
    )
