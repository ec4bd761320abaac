"""Queries: cost of runs, instances, optimisation and providers."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even, long_sum
from jobsight.functions.units import size_bytes
from jobsight.operators import cost
from jobsight.operators.cost import Pricing, Shape
from jobsight.operators.staircase import ANY, fitting_runs
from jobsight.plans.diagnosis import jobs, r
from jobsight.plans.registry import query
from jobsight.sources import catalogs as cat


def _values(rows, columns):
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else (f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v}::BIGINT")

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({', '.join(columns)})"


def _factor(values, key="provider", default=None):
    whens = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in values.items())
    return f"CASE {key} {whens} {'' if default is None else f'ELSE {default!r}::DOUBLE'} END"


_GIB = "1073741824e0"
COST_SQL = {
    "prices": _values([(i, *p) for i, p in enumerate(cat.PRICES)], ["position", *cat.PRICE_COLUMNS]),
    "region_prices": _values(
        [(p, n, f) for p, m in cat.REGION_FACTORS.items() for n, f in m.items()], ["provider", "region", "region_factor"]
    ),
    "compared_regions": _values(
        [(p, i, n, cat.REGION_FACTORS[p][n]) for p in cat.PROVIDERS for i, n in enumerate(cat.COMPARED_REGIONS[p])],
        ["provider", "region_no", "region", "region_factor"],
    ),
    "shapes": f"""
SELECT *, (duration_ms / 1000e0) / 3600e0 AS hours, num_executors * executor_cores + 1 AS total_cores,
  (num_executors * executor_memory_mb + driver_memory_mb) / 1024e0 AS memory_gb,
  shuffle_write_bytes / {_GIB} AS shuffle_gb, (input_bytes + output_bytes + shuffle_write_bytes) / {_GIB} AS moved_gb,
  {_factor({p: cat.SPOT_FACTORS[p] for p in cat.PROVIDERS})} AS spot_factor,
  {_factor({p: cat.RESERVED_FACTORS[p] for p in cat.PROVIDERS})} AS reserved_factor
FROM jobs""",
    "run_costs": """
SELECT *, total_cores * hours * 0.05e0 AS compute_cost, memory_gb * hours * 0.005e0 AS memory_cost,
  shuffle_gb * hours * 0.0001e0 AS storage_cost, moved_gb * 0.01e0 AS network_cost,
  total_cores * hours * 0.05e0 + memory_gb * hours * 0.005e0 + shuffle_gb * hours * 0.0001e0 + moved_gb * 0.01e0
    AS total_cost,
  total_cores * hours * (0.05e0 * spot_factor) + memory_gb * hours * (0.005e0 * spot_factor)
    + shuffle_gb * hours * 0.0001e0 + moved_gb * 0.01e0 AS spot_total,
  total_cores * hours * (0.05e0 * reserved_factor) + memory_gb * hours * (0.005e0 * reserved_factor)
    + shuffle_gb * hours * 0.0001e0 + moved_gb * 0.01e0 AS reserved_total,
  total_cores * hours * 0.05e0 + memory_gb * hours * 0.005e0 AS config_cost,
  total_cores * hours * (0.05e0 * spot_factor) + memory_gb * hours * (0.005e0 * spot_factor) AS config_spot
FROM shapes""",
    "fits": """
SELECT app_id, s.provider AS own_provider, p.*, num_executors, hours FROM shapes s
JOIN prices p ON p.vcpus >= executor_cores AND p.memory_gb >= executor_memory_mb / 1024e0""",
}


def priced(name: str, sql: str | None, extra: dict[str, str] | None = None):
    return query(name, sql, {**COST_SQL, **(extra or {})})


def _config_shape() -> Shape:
    """Shape of a run without its data, as an estimate from settings alone sees it."""
    s = cost.run_shape()
    return Shape(s.executors, s.cores, s.memory_mb, s.driver_mb, s.hours)


_PARTS = ["compute_cost", "memory_cost", "storage_cost", "network_cost"]


@priced(
    "cost_01_run_cost",
    f"""SELECT app_id, {', '.join(f'{r(c)} AS {c}' for c in _PARTS)}, {r('total_cost', 4)} AS total_cost,
      {r('CASE WHEN hours > 0 THEN total_cost / hours ELSE 0e0 END', 4)} AS cost_per_hour,
      2 + CASE WHEN shuffle_gb > 0 THEN 1 ELSE 0 END + CASE WHEN moved_gb > 0 THEN 1 ELSE 0 END AS items
    FROM run_costs""",
)
def _(t):
    s = cost.run_shape()
    parts = cost.cost_parts(s)
    total = cost.total_cost(s)
    return jobs(t).select(
        "app_id",
        *[half_even(v, 6).alias(k) for k, v in parts.items()],
        half_even(total, 4).alias("total_cost"),
        half_even(cost.per_hour(total, s.hours), 4).alias("cost_per_hour"),
        F.size(cost.breakdown(s, parts)).alias("items"),
    )


@priced(
    "cost_02_tier_cost",
    f"""SELECT app_id, provider, tier, {r('total', 4)} AS cost FROM run_costs, LATERAL (
      SELECT 'on_demand' AS tier, total_cost AS total UNION ALL SELECT 'spot', spot_total
      UNION ALL SELECT 'reserved', reserved_total) x""",
)
def _(t):
    s = cost.run_shape()
    tiers = F.array(
        *[
            F.struct(F.lit(x).alias("tier"), half_even(cost.total_cost(s, x, F.col("provider")), 4).alias("cost"))
            for x in (cost.ON_DEMAND, cost.SPOT, cost.RESERVED)
        ]
    )
    return jobs(t).select("app_id", "provider", F.inline(tiers))


@priced(
    "cost_03_storage_and_network",
    f"""SELECT app_id, {r('shuffle_gb * hours * 0.00005e0')} AS hdd_cost, {r('moved_gb * 0.02e0')} AS inter_region_cost,
      {r('moved_gb * 0.09e0')} AS internet_cost FROM shapes""",
)
def _(t):
    s = cost.run_shape()
    slow = cost.cost_parts(s, storage="hdd", transfer="inter_region")
    far = cost.cost_parts(s, transfer="internet")
    return jobs(t).select(
        "app_id",
        half_even(slow["storage_cost"], 6).alias("hdd_cost"),
        half_even(slow["network_cost"], 6).alias("inter_region_cost"),
        half_even(far["network_cost"], 6).alias("internet_cost"),
    )


@priced(
    "cost_04_cost_of_config",
    f"""SELECT app_id, {r('''(2 * executor_cores + 1) * hours * 0.05e0 + (2 * executor_memory_mb + 2048) / 1024e0 * hours * 0.005e0
      + CAST(floor(gb * 2e0 * 1073741824e0) AS BIGINT) / 1073741824e0 * hours * 0.0001e0
      + (CAST(floor(gb * 1e0 * 1073741824e0) AS BIGINT) + CAST(floor(gb * 0.5e0 * 1073741824e0) AS BIGINT)
         + CAST(floor(gb * 2e0 * 1073741824e0) AS BIGINT)) / 1073741824e0 * 0.01e0''', 4)} AS total_cost
    FROM (SELECT *, input_bytes / 1073741824e0 AS gb FROM shapes) x""",
)
def _(t):
    """Settings that leave out the executor count and the driver memory fall back to the defaults."""
    config = F.create_map(
        F.lit("spark.executor.cores"), F.col("executor_cores").cast("string"),
        F.lit("spark.executor.memory"), F.col("executor_memory_mb").cast("string"),
    )
    s = cost.config_shape(config, cost.run_shape().hours, F.col("input_bytes") / float(1024**3))
    return jobs(t).select("app_id", half_even(cost.total_cost(s), 4).alias("total_cost"))


@priced(
    "cost_05_cost_of_scaled_run",
    f"""SELECT app_id, {r('''total_cores * (hours * 1.5e0) * 0.05e0 + memory_gb * (hours * 1.5e0) * 0.005e0
      + CAST(floor(shuffle_write_bytes * 1.5e0) AS BIGINT) / 1073741824e0 * (hours * 1.5e0) * 0.0001e0
      + (CAST(floor(input_bytes * 1.5e0) AS BIGINT) + CAST(floor(output_bytes * 1.5e0) AS BIGINT)
         + CAST(floor(shuffle_write_bytes * 1.5e0) AS BIGINT)) / 1073741824e0 * 0.01e0''', 4)} AS total_cost
    FROM shapes""",
)
def _(t):
    return jobs(t).select("app_id", half_even(cost.total_cost(cost.run_shape(1.5)), 4).alias("total_cost"))


@priced(
    "cost_06_savings_and_advice",
    f"""SELECT app_id, {r('total_cost - spot_total', 4)} AS spot_savings, {r('total_cost - reserved_total', 4)} AS reserved_savings,
      CAST(total_cost - spot_total > 0.1e0 AS INT) + CAST(hours > 2 AND total_cost - reserved_total > 0.05e0 AS INT)
      + CAST(executor_memory_mb > 8192 AND num_executors > 5 AS INT) + CAST(shuffle_gb > 10 AS INT)
      + CAST(num_executors > 20 AND hours < 0.5e0 AS INT) AS advice
    FROM run_costs""",
)
def _(t):
    s = cost.run_shape()
    money = cost.savings(s, F.col("provider"))
    return jobs(t).select(
        "app_id",
        half_even(money["spot_savings"], 4).alias("spot_savings"),
        half_even(money["reserved_savings"], 4).alias("reserved_savings"),
        F.size(cost.cost_advice(s, money)).alias("advice"),
    )


def _named_instances(t):
    """Runs with the instance they asked for: one name is custom only, one is in both catalogs, one is unknown."""
    name = F.expr(
        "CASE executor_cores WHEN 1 THEN 'edge.small' WHEN 2 THEN 'm5.large' WHEN 4 THEN 'm5.xlarge' ELSE 'none' END"
    )
    return t.orders.withColumn("instance_type", name).withColumn("provider", F.lit("aws"))


_NAMED = """
SELECT app_id, team, num_executors, 'aws' AS provider,
  CASE executor_cores WHEN 1 THEN 'edge.small' WHEN 2 THEN 'm5.large' WHEN 4 THEN 'm5.xlarge' ELSE 'none' END
    AS instance_type FROM order_info"""


@priced(
    "join_06_price_adjustment",
    f"""SELECT app_id, region, {r('hourly_price * 0.3e0 * region_factor')} AS spot_price,
      {r('hourly_price * 0.6e0 * region_factor')} AS reserved_price
    FROM named JOIN prices USING (provider, instance_type) JOIN region_prices USING (provider)
    WHERE region IN ('eu-west-1', 'sa-east-1')""",
    {"named": _NAMED},
)
def _(t):
    spark = t.spark
    runs = _named_instances(t).select("app_id", "provider", "instance_type")
    factors = cat.regions(spark).filter(F.col("region").isin("eu-west-1", "sa-east-1"))
    joined = runs.join(F.broadcast(cat.prices(spark)), ["provider", "instance_type"]).join(
        F.broadcast(factors), "provider"
    )
    price = F.col("hourly_price")
    return joined.select(
        "app_id",
        "region",
        half_even(cost.instance_price(price, F.col("provider"), "spot") * F.col("region_factor"), 6).alias("spot_price"),
        half_even(cost.instance_price(price, F.col("provider"), "reserved_1y") * F.col("region_factor"), 6).alias(
            "reserved_price"
        ),
    )


@priced(
    "cost_07_instance_price",
    f"""SELECT app_id, instance_type, tier, {r('hourly_price * factor')} AS hourly_price FROM named
    JOIN prices USING (provider, instance_type),
    (VALUES ('on_demand', 1e0), ('preemptible', 0.3e0), ('reserved_1y', 0.6e0), ('reserved_3y', 0.4e0)) v(tier, factor)""",
    {"named": _NAMED},
)
def _(t):
    rows = _named_instances(t).join(F.broadcast(cat.prices(t.spark)), ["provider", "instance_type"])
    tiers = F.array(
        *[
            F.struct(
                F.lit(x).alias("tier"),
                half_even(cost.instance_price(F.col("hourly_price"), F.col("provider"), x), 6).alias("hourly_price"),
            )
            for x in ("on_demand", "preemptible", "reserved_1y", "reserved_3y")
        ]
    )
    return rows.select("app_id", "instance_type", F.inline(tiers))


_IMPORTED = """
SELECT p_partkey AS line, CASE p_partkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS provider,
  CASE WHEN p_size < 3 THEN NULL WHEN p_size < 10 THEN 'm5.large' ELSE lower(p_brand) || '-' || CAST(p_size AS VARCHAR) END
    AS instance_type, CAST(p_size AS BIGINT) AS vcpus, p_size * 4e0 AS memory_gb, p_retailprice / 1000 AS hourly_price
FROM part"""


def imported_prices(t):
    return t.raw("part").select(
        F.col("p_partkey").alias("line"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END").alias("provider"),
        F.expr(
            "CASE WHEN p_size < 3 THEN NULL WHEN p_size < 10 THEN 'm5.large'"
            " ELSE concat(lower(p_brand), '-', CAST(p_size AS STRING)) END"
        ).alias("instance_type"),
        F.col("p_size").cast("int").alias("vcpus"),
        (F.col("p_size") * F.lit(4.0)).alias("memory_gb"),
        (F.col("p_retailprice") / 1000).alias("hourly_price"),
    )


_MERGED = """
SELECT provider, instance_type, vcpus, memory_gb, hourly_price FROM (
  SELECT *, row_number() OVER (PARTITION BY provider, instance_type ORDER BY line DESC) AS n FROM (
    SELECT -1 AS line, provider, instance_type, vcpus, memory_gb, hourly_price FROM prices
    UNION ALL SELECT * FROM imported WHERE instance_type IS NOT NULL AND hourly_price >= 0) u) x WHERE n = 1"""


def merged_prices(t):
    return cost.merge_catalog(cat.prices(t.spark), imported_prices(t), "line")


_FITS = COST_SQL["fits"]
_LISTED_SQL = {k: v for k, v in COST_SQL.items() if k != "fits"} | {
    "imported": _IMPORTED,
    "merged": _MERGED,
    "listed": """
SELECT provider || '/' || instance_type AS position, *, CASE WHEN vcpus % 4 = 0 THEN 100 ELSE 0 END AS local_storage_gb FROM merged""",
    "fits": _FITS.replace("prices p", "listed p"),
}


def _listed(t):
    """The imported price list; every fourth size is said to have local storage."""
    storage = F.when(F.col("vcpus") % 4 == 0, 100).otherwise(0)
    return merged_prices(t).withColumns({"position": F.concat_ws("/", "provider", "instance_type"), "local_storage_gb": storage})


def with_catalogs(name: str, sql: str):
    """Register ``fn(tables, catalog)`` on the built-in price list and, as ``.._imported``, on one merged from a table."""

    def register(fn):
        priced(name, sql)(lambda t: fn(t, cat.prices(t.spark)))
        query(f"{name}_imported", sql, _LISTED_SQL)(lambda t: fn(t, _listed(t)))
        return fn

    return register


@with_catalogs(
    "join_05_fitting_instances",
    """SELECT app_id, COUNT(*) AS fitting, arg_min(instance_type, (hourly_price, position)) AS cheapest
    FROM fits GROUP BY app_id""",
)
def _(t, catalog):
    rows = fitting_runs(jobs(t), catalog, 1, F.lit(ANY), ["app_id"], tie="position")
    return rows.select("app_id", "fitting", F.col("best")[0]["instance_type"].alias("cheapest"))


def _top_fits(name, prefer, order, spark_tier, price):
    @with_catalogs(
        name,
        f"""SELECT app_id, string_agg(instance_type, ',' ORDER BY place) AS instances FROM (
          SELECT app_id, instance_type, row_number() OVER (PARTITION BY app_id ORDER BY {order}) AS place
          FROM (SELECT * REPLACE ({price} AS hourly_price) FROM fits WHERE provider = own_provider) f) x
        WHERE place <= 3 GROUP BY app_id""",
    )
    def _(t, catalog):
        tier_price = cost.instance_price(F.col("hourly_price"), F.col("provider"), spark_tier)
        last = F.col("local_storage_gb") == 0 if prefer else F.lit(False)
        rows = fitting_runs(jobs(t), catalog, 3, F.col("provider"), ["app_id"], price=tier_price, last=last, tie="position")
        return rows.select("app_id", F.array_join(F.col("best.instance_type"), ",").alias("instances"))


_top_fits("cost_08_best_instances", False, "hourly_price, position", "on_demand", "hourly_price")
_top_fits(
    "top_04_local_storage_first", True, "local_storage_gb = 0, hourly_price, position", "reserved_3y",
    "hourly_price * 0.4e0",
)


@with_catalogs(
    "cost_09_cheapest_per_provider",
    """SELECT app_id, provider, arg_min(instance_type, (hourly_price, position)) AS instance_type,
      MIN(hourly_price) AS hourly_price FROM fits GROUP BY app_id, provider""",
)
def _(t, catalog):
    each = jobs(t).withColumn("_provider", F.explode(F.array(*[F.lit(p) for p in cat.PROVIDERS])))
    rows = fitting_runs(each, catalog, 1, F.col("_provider"), ["app_id"], tie="position")
    best = F.col("best")[0]
    return rows.select("app_id", "provider", best["instance_type"].alias("instance_type"), best["hourly_price"].alias("hourly_price"))


@with_catalogs(
    "cost_10_regional_prices",
    f"""SELECT provider, instance_type, region, COUNT(*) AS runs, {r('ANY_VALUE(hourly_price) * ANY_VALUE(region_factor)', 4)} AS price
    FROM (SELECT app_id, own_provider AS provider, arg_min(instance_type, (hourly_price, position)) AS instance_type,
        MIN(hourly_price) AS hourly_price FROM fits WHERE provider = own_provider GROUP BY ALL) b
    JOIN region_prices USING (provider) GROUP BY provider, instance_type, region""",
)
def _(t, catalog):
    """Price in every region of the instances the runs need."""
    best = fitting_runs(jobs(t), catalog, 1, F.col("provider"), tie="position").select(F.col("best")[0].alias("i"))
    used = best.groupBy("i.provider", "i.instance_type", "i.hourly_price").agg(F.count(F.lit(1)).alias("runs"))
    return used.join(F.broadcast(cat.regions(t.spark)), "provider").select(
        "provider", "instance_type", "region", "runs",
        cost.regional_price(F.col("hourly_price"), F.col("region_factor")).alias("price"),
    )


@priced(
    "cost_11_monthly_instance_cost",
    f"""SELECT app_id, {r('hourly_price * num_executors * 720', 4)} AS monthly_cost FROM named
    JOIN prices USING (provider, instance_type)""",
    {"named": _NAMED},
)
def _(t):
    rows = _named_instances(t).join(F.broadcast(cat.prices(t.spark)), ["provider", "instance_type"])
    month = cost.monthly_instance_cost(F.col("hourly_price"), F.col("num_executors"))
    return rows.select("app_id", half_even(month, 4).alias("monthly_cost"))


@priced(
    "cost_12_custom_price_lookup",
    """SELECT app_id, instance_type, coalesce(p.hourly_price, c.hourly_price) AS hourly_price FROM named
    LEFT JOIN prices p USING (provider, instance_type)
    LEFT JOIN (VALUES ('aws', 'edge.small', 0.021e0), ('aws', 'm5.large', 0.5e0)) c(provider, instance_type, hourly_price)
      USING (provider, instance_type)""",
    {"named": _NAMED},
)
def _(t):
    custom = t.spark.createDataFrame(
        [("aws", "edge.small", 0.021), ("aws", "m5.large", 0.5)],
        "provider string, instance_type string, hourly_price double",
    )
    runs = _named_instances(t).select("app_id", "provider", "instance_type")
    return cost.priced_with_custom(runs, F.broadcast(cat.prices(t.spark)), F.broadcast(custom)).select(
        "app_id", "instance_type", "hourly_price"
    )


# Optimisation: the fold over candidates, spelled out for the SQL side


def _option(e, m):
    c = f"(({e}) * executor_cores + 1) * hours * 0.05e0 + (({e}) * ({m}) + driver_memory_mb) / 1024e0 * hours * 0.005e0"
    return f"{{'e': ({e}), 'm': ({m}), 'cost': {c}, 'rate': CASE WHEN hours > 0 THEN ({c}) / hours ELSE 0e0 END}}"


def _options(e_range, m_range):
    return "[" + ", ".join(_option(e, m) for e in e_range for m in m_range) + "]"


_E, _M = "num_executors", "executor_memory_mb"
_OPTIMIZED = f"""
SELECT *, list_reduce(list_prepend(current_option, list_filter(options, lambda o: o.e BETWEEN 1 AND 100
    AND o.m BETWEEN 1024 AND 32768 AND (budget IS NULL OR o.cost <= budget))),
  lambda b, o: CASE WHEN CASE goal WHEN 'minimize_duration' THEN o.rate > b.rate
      WHEN 'balance' THEN o.cost / greatest(b.cost, 0.01e0) * 0.6e0 + b.rate / greatest(o.rate, 0.01e0) * 0.4e0 < 1e0
      ELSE o.cost < b.cost END THEN o ELSE b END) AS best
FROM (SELECT *, {_option(_E, _M)} AS current_option,
  CASE goal WHEN 'minimize_cost' THEN {_options([f'greatest(1, {_E} - 2)', _E, f'{_E} + 1'], [f'greatest(1024, {_M} - 2048)', _M])}
    WHEN 'minimize_duration' THEN {_options([_E, f'{_E} + 2', f'{_E} + 4'], [_M, f'{_M} + 2048'])}
    ELSE {_options([f'greatest(1, {_E} - 1)', _E, f'{_E} + 1'], [f'greatest(1024, {_M} - 1024)', _M, f'{_M} + 1024'])}
  END AS options
FROM (SELECT *, GOAL AS goal, BUDGET AS budget FROM shapes) g) x"""

_GOALS = {"cost": cost.MINIMIZE_COST, "performance": cost.MINIMIZE_DURATION}
_GOAL_SQL = "CASE priority WHEN 'cost' THEN 'minimize_cost' WHEN 'performance' THEN 'minimize_duration' ELSE 'balance' END"


def _goal():
    return F.when(F.col("priority") == "cost", cost.MINIMIZE_COST).when(
        F.col("priority") == "performance", cost.MINIMIZE_DURATION
    ).otherwise(cost.BALANCE)


def _optimized_sql(goal, budget="CAST(NULL AS DOUBLE)"):
    return _OPTIMIZED.replace("GOAL", goal).replace("BUDGET", budget)


@priced(
    "cost_13_optimize_config",
    f"""SELECT app_id, best.e AS optimized_executors, best.m AS optimized_memory_mb,
      {r('current_option.cost', 4)} AS original_cost, {r('best.cost', 4)} AS optimized_cost,
      {r('CASE WHEN current_option.cost > 0 THEN (current_option.cost - best.cost) / current_option.cost * 100 ELSE 0e0 END', 2)}
        AS savings_percent
    FROM optimized""",
    {"optimized": _optimized_sql(_GOAL_SQL)},
)
def _(t):
    out = cost.optimize(jobs(t), _goal(), cost.run_shape().hours, provider=F.col("provider"))
    return out.select(
        "app_id",
        "optimized_executors",
        "optimized_memory_mb",
        half_even("original_cost", 4).alias("original_cost"),
        half_even("optimized_cost", 4).alias("optimized_cost"),
        half_even("savings_percent", 2).alias("savings_percent"),
    )


@priced(
    "cost_14_balance_goal",
    f"""SELECT app_id, best.e AS optimized_executors, best.m AS optimized_memory_mb, {r('best.cost', 4)} AS optimized_cost
    FROM optimized""",
    {"optimized": _optimized_sql("'balance'")},
)
def _(t):
    out = cost.optimize(jobs(t), F.lit(cost.BALANCE), cost.run_shape().hours)
    return out.select(
        "app_id", "optimized_executors", "optimized_memory_mb", half_even("optimized_cost", 4).alias("optimized_cost")
    )


@priced(
    "cost_15_optimize_for_budget",
    f"""SELECT app_id, best.e AS optimized_executors, best.m AS optimized_memory_mb, {r('best.cost', 4)} AS optimized_cost
    FROM optimized""",
    {"optimized": _optimized_sql("'budget_constraint'", "2e0")},
)
def _(t):
    out = cost.optimize(jobs(t), F.lit(cost.BUDGET), cost.run_shape().hours, budget=F.lit(2.0))
    return out.select(
        "app_id", "optimized_executors", "optimized_memory_mb", half_even("optimized_cost", 4).alias("optimized_cost")
    )


@priced(
    "cost_19_advice_and_trade_offs",
    """SELECT app_id, concat_ws('; ', CASE WHEN saved > 0 THEN 'Potential savings: $' || printf('%.2f', saved) END,
        CASE WHEN best.e < num_executors THEN 'Reduce executors from ' || num_executors || ' to ' || best.e END,
        CASE WHEN best.e > num_executors
          THEN 'Increase executors from ' || num_executors || ' to ' || best.e || ' for better performance' END,
        CASE WHEN best.m < executor_memory_mb
          THEN 'Reduce executor memory from ' || executor_memory_mb || 'MB to ' || best.m || 'MB' END,
        CASE WHEN best.m > executor_memory_mb
          THEN 'Increase executor memory from ' || executor_memory_mb || 'MB to ' || best.m || 'MB' END,
        CASE goal WHEN 'minimize_cost' THEN 'Consider spot instances for additional savings'
          WHEN 'minimize_duration' THEN 'Enable dynamic allocation for peak efficiency' END) AS advice,
      concat_ws('; ', CASE WHEN best.e < num_executors THEN 'Fewer executors may increase job duration' END,
        CASE WHEN best.m < executor_memory_mb THEN 'Less memory may cause increased spilling or GC pressure' END)
        AS trade_offs
    FROM (SELECT *, current_option.cost - best.cost AS saved FROM optimized) x""",
    {"optimized": _optimized_sql(_GOAL_SQL)},
)
def _(t):
    out = cost.optimize(jobs(t), _goal(), cost.run_shape().hours)
    return out.select(
        "app_id", *[F.array_join(c, "; ").alias(n) for c, n in (("recommendations", "advice"), ("trade_offs", "trade_offs"))]
    )


_FRONTIER = """
SELECT app_id, scale, e, h, (e * executor_cores + 1) * h * 0.05e0
    + (e * executor_memory_mb + driver_memory_mb) / 1024e0 * h * 0.005e0 AS cost
FROM (SELECT *, greatest(1, CAST(floor(num_executors * scale) AS BIGINT)) AS e,
    hours * (1e0 / (0.5e0 + 0.5e0 * scale)) AS h
  FROM shapes, (VALUES (0.5e0), (0.875e0), (1.25e0), (1.625e0), (2e0)) v(scale)) x"""


@priced(
    "cost_16_cost_duration_frontier",
    f"SELECT app_id, scale, e AS executors, {r('h')} AS hours, {r('cost')} AS cost FROM frontier",
    {"frontier": _FRONTIER},
)
def _(t):
    out = cost.frontier(jobs(t), cost.run_shape().hours)
    return out.select("app_id", "scale", "executors", half_even("hours", 6).alias("hours"), half_even("cost", 6).alias("cost"))


@priced(
    "top_08_ordered_frontier",
    f"""SELECT app_id, row_number() OVER (PARTITION BY app_id ORDER BY cost, scale) - 1 AS place, scale FROM frontier""",
    {"frontier": _FRONTIER},
)
def _(t):
    return cost.frontier(jobs(t), cost.run_shape().hours).select("app_id", F.col("place").cast("long"), "scale")


@with_catalogs(
    "cost_17_compare_instance_types",
    f"""SELECT app_id, place - 1 AS place, instance_type, {r('hourly_price * num_executors * hours', 4)} AS total_cost FROM (
      SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY hourly_price, position) AS place FROM fits
      WHERE provider = own_provider) x WHERE place <= 10""",
)
def _(t, catalog):
    out = cost.instance_comparison(jobs(t), catalog, cost.run_shape().hours, F.col("provider"), tie="position")
    return out.select("app_id", F.col("place").cast("long"), "instance_type", "total_cost")


@priced(
    "cost_18_spot_strategy",
    f"""SELECT app_id, CASE WHEN tolerance >= 0.7e0 AND config_cost - expected > 0 THEN 'full_spot'
        WHEN tolerance >= 0.4e0 THEN 'mixed' ELSE 'on_demand' END AS strategy,
      {r('config_cost', 4)} AS on_demand_cost, {r('config_spot', 4)} AS spot_cost, {r('expected', 4)} AS expected_cost,
      {r('risk * 100', 1)} AS interruption_probability
    FROM (SELECT *, config_spot * (1e0 + risk * 0.5e0) AS expected FROM (
      SELECT *, 1e0 - pow(0.95e0, hours) AS risk,
        CASE job_type WHEN 'batch' THEN 0.9e0 WHEN 'etl' THEN 0.5e0 ELSE 0.2e0 END AS tolerance FROM run_costs) x) y""",
)
def _(t):
    tolerance = F.when(F.col("job_type") == "batch", 0.9).when(F.col("job_type") == "etl", 0.5).otherwise(0.2)
    plan = cost.spot_strategy(_config_shape(), F.col("provider"), tolerance)
    wanted = ["strategy", "on_demand_cost", "spot_cost", "expected_cost", "interruption_probability"]
    return jobs(t).select("app_id", *[plan[w].alias(w) for w in wanted])


@priced(
    "cost_20_provider_comparison",
    f"""SELECT app_id, 'aws' AS cheapest_provider, {r('config_cost', 4)} AS cheapest_cost,
      'azure' AS most_expensive_provider, 0e0 AS savings FROM run_costs""",
)
def _(t):
    """All providers share the on-demand price, so the tie goes to the first one."""
    out = cost.compare_providers(jobs(t), _config_shape())
    return out.select(
        "app_id",
        "cheapest_provider",
        half_even("cheapest_cost", 4).alias("cheapest_cost"),
        "most_expensive_provider",
        half_even("savings", 4).alias("savings"),
    )


_CUSTOM = {"gcp": Pricing(compute=0.045, memory=0.0052), "azure": Pricing(compute=0.052, memory=0.0041)}
_CUSTOM_SQL = """
SELECT app_id, p.name AS provider, p.position, total_cores * hours * c + memory_gb * hours * m AS cost FROM shapes,
  (VALUES ('aws', 0, 0.05e0, 0.005e0), ('gcp', 1, 0.045e0, 0.0052e0), ('azure', 2, 0.052e0, 0.0041e0))
    p(name, position, c, m)"""


@priced(
    "udx_05_custom_price_table",
    f"""SELECT app_id, arg_min(provider, (cost, position)) AS cheapest_provider, {r('MIN(cost)', 4)} AS cheapest_cost,
      {r('MAX(cost) - MIN(cost)', 4)} AS savings FROM custom_costs GROUP BY app_id""",
    {"custom_costs": _CUSTOM_SQL},
)
def _(t):
    out = cost.compare_providers(jobs(t), _config_shape(), _CUSTOM)
    return out.select(
        "app_id",
        "cheapest_provider",
        half_even("cheapest_cost", 4).alias("cheapest_cost"),
        half_even("savings", 4).alias("savings"),
    )


@priced(
    "win_10_provider_ranking",
    """SELECT app_id, provider, row_number() OVER (PARTITION BY app_id ORDER BY cost, position) AS place
    FROM custom_costs""",
    {"custom_costs": _CUSTOM_SQL},
)
def _(t):
    ranked = cost.compare_providers(jobs(t), _config_shape(), _CUSTOM)
    out = ranked.select("app_id", F.posexplode("ranking").alias("place", "provider"))
    return out.withColumn("place", (F.col("place") + 1).cast("long"))


@priced(
    "cost_21_region_costs",
    f"SELECT app_id, region, {r('config_spot_free', 4)} AS cost FROM (SELECT *, config_cost AS config_spot_free FROM run_costs) JOIN compared_regions USING (provider)",
)
def _(t):
    return cost.region_costs(jobs(t), _config_shape()).drop("provider")


@priced(
    "cost_21_region_costs_with_factor",
    f"SELECT app_id, region, {r('config_cost * region_factor', 4)} AS cost FROM run_costs JOIN compared_regions USING (provider)",
)
def _(t):
    return cost.region_costs(jobs(t), _config_shape(), with_region_factor=True).drop("provider")


_OPTION_ROWS = """
SELECT app_id, p.provider, region, tier, p_no * 8 + region_no * 2 + tier_no AS position,
  total_cores * hours * (0.05e0 * f) + memory_gb * hours * (0.005e0 * f) AS cost
FROM shapes, (SELECT provider, region, region_no, tier, tier_no,
    CASE provider WHEN 'aws' THEN 0 WHEN 'gcp' THEN 1 ELSE 2 END AS p_no,
    CASE WHEN tier = 'on_demand' THEN 1e0 WHEN provider = 'aws' THEN 0.3e0 WHEN provider = 'gcp' THEN 0.2e0
      ELSE 0.35e0 END AS f
  FROM compared_regions, (VALUES ('on_demand', 0), ('spot', 1)) v(tier, tier_no)) p"""


def _cheapest(name, limit, columns):
    @priced(
        name,
        f"""SELECT app_id, {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY app_id
          ORDER BY cost, position) - 1 AS place, CAST(24 AS INT) AS total_options_analyzed FROM
          (SELECT * REPLACE ({r('cost')} AS cost) FROM option_rows) o) x WHERE place < {limit}""",
        {"option_rows": _OPTION_ROWS},
    )
    def _(t):
        out = cost.cheapest_options(jobs(t), _config_shape(), k=limit)
        out = out.withColumns({"place": F.col("place").cast("long"), "cost": half_even("cost", 6)})
        return out.select("app_id", *columns)


_cheapest("cost_22_cheapest_option", 1, ["provider", "region", "tier", "cost", "total_options_analyzed"])
_cheapest("top_05_ten_cheapest_options", 10, ["place", "provider", "region", "tier", "cost"])
_cheapest("set_03_union_of_options", 24, ["provider", "region", "tier", "cost"])
_cheapest("join_11_option_grid", 24, ["place", "region", "tier"])


@priced(
    "join_10_candidate_grid",
    """SELECT app_id, o.e AS executors, o.m AS memory FROM (SELECT app_id, unnest(options) AS o FROM optimized) x
    WHERE o.e BETWEEN 1 AND 100 AND o.m BETWEEN 1024 AND 32768""",
    {"optimized": _optimized_sql(_GOAL_SQL)},
)
def _(t):
    grid = cost.candidate_grid(
        _goal(), F.col("num_executors").cast("long"), F.col("executor_memory_mb").cast("long")
    )
    return jobs(t).select("app_id", F.inline(grid))


@priced(
    "cost_23_migration",
    f"""SELECT app_id, {r('source - target', 4)} AS job_savings, {r('gb * 0.09e0', 4)} AS total_migration_cost,
      {r('monthly', 4)} AS estimated_monthly_savings,
      {r('CASE WHEN monthly > 0 THEN gb * 0.09e0 / monthly END', 1)} AS payback_months,
      CASE WHEN monthly <= 0 THEN 'Migration not recommended - no cost savings expected'
        WHEN gb * 0.09e0 / monthly < 3 THEN 'Strongly recommended - quick payback period'
        WHEN gb * 0.09e0 / monthly < 6 THEN 'Recommended - reasonable payback period'
        WHEN gb * 0.09e0 / monthly < 12 THEN 'Consider carefully - long payback period'
        ELSE 'Not recommended - payback period exceeds 1 year' END AS recommendation
    FROM (SELECT *, CASE WHEN hours > 0 THEN (source - target) * 720 / hours ELSE 0e0 END AS monthly FROM (
      SELECT s.app_id, hours, input_bytes / 1073741824e0 AS gb,
        a.cost AS source, g.cost AS target FROM shapes s
        JOIN custom_costs a ON a.app_id = s.app_id AND a.provider = s.provider
        JOIN custom_costs g ON g.app_id = s.app_id AND g.provider = 'gcp') x) y""",
    {"custom_costs": _CUSTOM_SQL},
)
def _(t):
    s = _config_shape()
    here = F.lit(None).cast("double")
    for p in cat.PROVIDERS:
        mine = cost.total_cost(s, cost.ON_DEMAND, p, _CUSTOM.get(p, cost.DEFAULT_PRICING))
        here = F.when(F.col("provider") == p, mine).otherwise(here)
    there = cost.total_cost(s, cost.ON_DEMAND, "gcp", _CUSTOM["gcp"])
    move = cost.migration(here, there, s.hours, F.col("input_bytes") / float(1024**3))
    wanted = ["job_savings", "total_migration_cost", "estimated_monthly_savings", "payback_months", "recommendation"]
    return jobs(t).select("app_id", *[move[w].alias(w) for w in wanted])


@priced(
    "cost_24_recommend_provider",
    f"""SELECT app_id, arg_max(provider, score) AS recommended_provider, {r('MAX(score)')} AS score FROM (
      SELECT app_id, p.provider, 0.4e0 * (1e0 / (1e0 + config_cost)) + 0.3e0 * variety + 0.3e0 * reliable AS score
      FROM run_costs, (VALUES ('aws', 0.6e0, 0.95e0), ('gcp', 0.55e0, 0.93e0), ('azure', 0.45e0, 0.94e0))
        p(provider, variety, reliable)) x GROUP BY app_id""",
)
def _(t):
    out = cost.recommend_provider(jobs(t), _config_shape())
    return out.withColumn("score", half_even("score", 6))


@priced(
    "agg_14_provider_summary",
    f"""SELECT provider, runs, instance_count, min_price, max_price, {r('avg_price')} AS avg_price, min_vcpus, max_vcpus,
      max_memory FROM (SELECT provider, COUNT(*) AS runs FROM order_info GROUP BY provider) a
    JOIN (SELECT provider, COUNT(*) AS instance_count, MIN(hourly_price) AS min_price, MAX(hourly_price) AS max_price,
        AVG(hourly_price) AS avg_price, MIN(vcpus) AS min_vcpus, MAX(vcpus) AS max_vcpus, MAX(memory_gb) AS max_memory
      FROM prices GROUP BY provider) p USING (provider)""",
)
def _(t):
    offers = (
        cat.prices(t.spark)
        .groupBy("provider")
        .agg(
            F.count(F.lit(1)).alias("instance_count"),
            F.min("hourly_price").alias("min_price"),
            F.max("hourly_price").alias("max_price"),
            half_even(F.avg("hourly_price"), 6).alias("avg_price"),
            F.min("vcpus").cast("long").alias("min_vcpus"),
            F.max("vcpus").cast("long").alias("max_vcpus"),
            F.max("memory_gb").alias("max_memory"),
        )
    )
    return t.orders.groupBy("provider").agg(F.count(F.lit(1)).alias("runs")).join(F.broadcast(offers), "provider")


@priced(
    "agg_23_monthly_projection",
    f"""SELECT provider, {r('m', 2)} AS monthly_on_demand, {r('m * 0.3e0', 2)} AS monthly_spot,
      {r('m * 0.6e0', 2)} AS monthly_reserved
    FROM (SELECT provider, SUM(CAST({r('config_cost * 1e6', 0)} AS BIGINT)) / 1e6 / (SUM(duration_ms) / 3600000e0) * 720 AS m
      FROM run_costs GROUP BY provider) x""",
)
def _(t):
    """Costs add up in whole millionths, so the order of the rows cannot change the sum."""
    micro = F.rint(cost.total_cost(_config_shape()) * 1e6).cast("long")
    sums = jobs(t).groupBy("provider").agg(long_sum(micro).alias("micro"), long_sum("duration_ms").alias("ms"))
    month = cost.monthly_projection(F.col("micro") / F.lit(1e6), F.col("ms") / F.lit(3600000.0))
    return sums.select("provider", *[half_even(v, 2).alias(k) for k, v in month.items()])


@priced(
    "flt_24_catalog_for_runs",
    """SELECT DISTINCT p.provider, p.instance_type, p.hourly_price FROM prices p JOIN order_info o
      ON o.provider = p.provider AND p.vcpus >= o.executor_cores AND p.vcpus >= 4 AND p.memory_gb >= 16""",
)
def _(t):
    """Catalog rows within bounds that some run of the provider could use."""
    needs = t.orders.groupBy("provider").agg(F.min("executor_cores").alias("least_cores"))
    listed = cat.prices(t.spark).filter((F.col("vcpus") >= 4) & (F.col("memory_gb") >= 16))
    fit = needs.join(F.broadcast(listed), "provider").filter(F.col("vcpus") >= F.col("least_cores"))
    return fit.select("provider", "instance_type", "hourly_price").orderBy("provider", "hourly_price", "instance_type")


@priced(
    "set_05_catalog_merge",
    _MERGED,
    {"imported": _IMPORTED},
)
def _(t):
    return merged_prices(t).withColumn("vcpus", F.col("vcpus").cast("long"))


@priced(
    "sca_04_requested_size_strings",
    """SELECT request_id, CASE request_id % 4 WHEN 0 THEN request_id * 1073741824 WHEN 1 THEN request_id * 1048576
      WHEN 2 THEN request_id END AS bytes FROM requests""",
)
def _(t):
    text = F.expr(
        "CASE request_id % 4 WHEN 0 THEN concat(request_id, 'GB') WHEN 1 THEN concat(' ', request_id, ' mb')"
        " WHEN 2 THEN concat(request_id, 'B') ELSE concat(request_id, ' apples') END"
    )
    return t.requests.select("request_id", size_bytes(text).alias("bytes"))
