"""Cost of runs, instance choice, configuration optimisation and provider comparison.

Everything is a projection of the row: catalogs and option grids are arrays
inside the row, so nothing here shuffles unless a result is grouped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import collected, fixed, half_even, to_gib
from jobsight.operators.staircase import fitting_runs
from jobsight.sources import catalogs as cat

ON_DEMAND, SPOT, PREEMPTIBLE, RESERVED, SAVINGS_PLAN = "on_demand", "spot", "preemptible", "reserved", "savings_plan"
HOURS_PER_MONTH = 720


@dataclass(frozen=True)
class Pricing:
    """USD per vCPU hour, per GB hour of memory, per GB hour of storage, per GB moved."""

    compute: float = 0.05
    memory: float = 0.005
    storage: dict[str, float] = field(default_factory=lambda: {"ssd": 0.0001, "hdd": 0.00005})
    network: dict[str, float] = field(
        default_factory=lambda: {"intra_region": 0.01, "inter_region": 0.02, "internet": 0.09}
    )
    default_storage: float = 0.0001
    default_network: float = 0.01


DEFAULT_PRICING = Pricing()


def tier_factor(tier: str | Column, provider: str | Column) -> Column:
    """Share of the on-demand price, by tier and provider."""
    if isinstance(tier, str):
        if tier in (SPOT, PREEMPTIBLE):
            factors, default = cat.SPOT_FACTORS, cat.DEFAULT_SPOT
        elif tier in (RESERVED, SAVINGS_PLAN):
            factors, default = cat.RESERVED_FACTORS, cat.DEFAULT_RESERVED
        else:
            return F.lit(1.0)
        if isinstance(provider, str):
            return F.lit(factors.get(provider, default))
        return cat.lookup(factors, provider, default)
    return (
        F.when(tier.isin(SPOT, PREEMPTIBLE), tier_factor(SPOT, provider))
        .when(tier.isin(RESERVED, SAVINGS_PLAN), tier_factor(RESERVED, provider))
        .otherwise(F.lit(1.0))
    )


@dataclass(frozen=True)
class Shape:
    """The columns a cost depends on."""

    executors: Column
    cores: Column
    memory_mb: Column
    driver_mb: Column
    hours: Column
    shuffle_bytes: Column = field(default_factory=lambda: F.lit(0))
    input_bytes: Column = field(default_factory=lambda: F.lit(0))
    output_bytes: Column = field(default_factory=lambda: F.lit(0))

    @property
    def total_cores(self) -> Column:
        return self.executors.cast("long") * self.cores.cast("long") + 1

    @property
    def memory_gb(self) -> Column:
        return (self.executors.cast("long") * self.memory_mb.cast("long") + self.driver_mb.cast("long")) / 1024.0


def run_shape(scale: float = 1.0) -> Shape:
    """Shape of a finished run, its time and data scaled."""
    scaled = lambda c: F.floor(F.col(c) * F.lit(scale)).cast("long") if scale != 1.0 else F.col(c)
    return Shape(
        F.col("num_executors"),
        F.col("executor_cores"),
        F.col("executor_memory_mb"),
        F.col("driver_memory_mb"),
        (F.col("duration_ms") / 1000.0 / 3600.0) * F.lit(scale),
        scaled("shuffle_write_bytes"),
        scaled("input_bytes"),
        scaled("output_bytes"),
    )


def config_shape(config: Column, hours: Column, data_gb: Column | None = None) -> Shape:
    """Shape of a settings map; data is shuffled twice over and half of it written. The defaults."""
    setting = lambda k, d: F.coalesce(config[k].cast("long"), F.lit(d))
    gb = data_gb if data_gb is not None else F.lit(0.0)
    b = lambda share: F.floor(gb * F.lit(share) * float(1024**3)).cast("long")
    return Shape(
        setting("spark.executor.instances", 2),
        setting("spark.executor.cores", 4),
        setting("spark.executor.memory", 4096),
        setting("spark.driver.memory", 2048),
        hours,
        b(2.0),
        b(1.0),
        b(0.5),
    )


def cost_parts(
    s: Shape,
    tier: str | Column = ON_DEMAND,
    provider: str | Column = "generic",
    pricing: Pricing = DEFAULT_PRICING,
    storage: str = "ssd",
    transfer: str = "intra_region",
) -> dict[str, Column]:
    """Compute, memory, storage and network cost of a shape, unrounded."""
    factor = tier_factor(tier, provider)
    shuffle_gb = to_gib(s.shuffle_bytes)
    moved_gb = to_gib(s.input_bytes + s.output_bytes + s.shuffle_bytes)
    return {
        "compute_cost": s.total_cores * s.hours * (F.lit(pricing.compute) * factor),
        "memory_cost": s.memory_gb * s.hours * (F.lit(pricing.memory) * factor),
        "storage_cost": shuffle_gb * s.hours * F.lit(pricing.storage.get(storage, pricing.default_storage)),
        "network_cost": moved_gb * F.lit(pricing.network.get(transfer, pricing.default_network)),
    }


def total_cost(s: Shape, tier=ON_DEMAND, provider="generic", pricing: Pricing = DEFAULT_PRICING) -> Column:
    c, m, st, n = cost_parts(s, tier, provider, pricing).values()
    return c + m + st + n


def per_hour(cost: Column, hours: Column) -> Column:
    return F.when(hours > 0, cost / hours).otherwise(F.lit(0.0))


def breakdown(s: Shape, parts: dict[str, Column]) -> Column:
    """Array of struct(resource_type, quantity, unit, unit_price, total_cost, duration_hours)."""

    def item(kind: str, quantity: Column, unit: str, cost: Column, timed: bool) -> Column:
        quantity = quantity.cast("double")
        basis = quantity * s.hours if timed else quantity
        return F.struct(
            F.lit(kind).alias("resource_type"),
            quantity.alias("quantity"),
            F.lit(unit).alias("unit"),
            F.when(basis > 0, cost / basis).otherwise(F.lit(0.0)).alias("unit_price"),
            cost.alias("total_cost"),
            (s.hours if timed else F.lit(0.0)).alias("duration_hours"),
        )

    always = F.lit(True)
    shuffle_gb = to_gib(s.shuffle_bytes)
    moved_gb = to_gib(s.input_bytes + s.output_bytes + s.shuffle_bytes)
    return collected(
        (always, item("compute", s.total_cores, "vCPU-hours", parts["compute_cost"], True)),
        (always, item("memory", s.memory_gb, "GB-hours", parts["memory_cost"], True)),
        (shuffle_gb > 0, item("storage", shuffle_gb, "GB-hours", parts["storage_cost"], True)),
        (moved_gb > 0, item("network", moved_gb, "GB", parts["network_cost"], False)),
    )


def savings(s: Shape, provider: str | Column = "generic", pricing: Pricing = DEFAULT_PRICING) -> dict[str, Column]:
    """On-demand cost and what spot or reserved capacity would save."""
    on_demand = total_cost(s, ON_DEMAND, provider, pricing)
    return {
        "total_cost": on_demand,
        "spot_savings": on_demand - total_cost(s, SPOT, provider, pricing),
        "reserved_savings": on_demand - total_cost(s, RESERVED, provider, pricing),
    }


def cost_advice(s: Shape, money: dict[str, Column]) -> Column:
    """Array of advice texts. Thresholds and texts."""
    total, spot, reserved = money["total_cost"], money["spot_savings"], money["reserved_savings"]
    shuffle_gb = to_gib(s.shuffle_bytes)
    percent = F.when(total > 0, spot / total * 100).otherwise(F.lit(0.0))
    return collected(
        (spot > 0.10, F.format_string("Consider using spot instances to save $%.2f (%.0f%%)", spot, percent)),
        (
            (s.hours > 2) & (reserved > 0.05),
            F.format_string("For recurring jobs, reserved instances could save $%.2f", reserved),
        ),
        ((s.memory_mb > 8192) & (s.executors > 5), F.lit("Consider reducing executor memory if GC time is low")),
        (
            shuffle_gb > 10,
            F.format_string("High shuffle volume (%.1f GB). Consider optimizing partitioning", shuffle_gb),
        ),
        (
            (s.executors > 20) & (s.hours < 0.5),
            F.lit("Job is short with many executors. Consider reducing executor count"),
        ),
    )


# Instances -----------------------------------------------------------------


def instance_price(price: Column, provider: Column, tier: str) -> Column:
    """Hourly price in a tier."""
    if tier in cat.SPOT_TIERS:
        return price * cat.lookup({k: cat.SPOT_FACTORS[k] for k in cat.PROVIDERS}, provider, cat.DEFAULT_SPOT)
    return price * F.lit(cat.TIER_FACTORS.get(tier, 1.0))


def matching_instances(
    vcpus: Column,
    memory_gb: Column,
    provider: Column | None = None,
    tier: str = ON_DEMAND,
    prefer_local_storage: bool = False,
) -> Column:
    """Array of the instances of the built-in price list that are large enough, cheapest first; with local storage first
    if preferred.

    The list is unrolled into the expression; ``staircase.fitting`` does the same for a catalog table of any size.
    """
    items = []
    for position, row in enumerate(cat.PRICES):
        i = dict(zip(cat.PRICE_COLUMNS, row))
        fits = (vcpus <= i["vcpus"]) & (memory_gb <= i["memory_gb"])
        if provider is not None:
            fits = fits & (provider == i["provider"])
        items.append(
            (
                fits,
                F.struct(
                    F.lit(prefer_local_storage and i["local_storage_gb"] == 0).alias("without_storage"),
                    instance_price(F.lit(i["hourly_price"]), F.lit(i["provider"]), tier).alias("hourly_price"),
                    F.lit(position).alias("position"),
                    *[F.lit(i[c]).alias(c) for c in ("instance_type", "provider", "vcpus", "memory_gb", "local_storage_gb")],
                ),
            )
        )
    return F.sort_array(collected(*items))


def first_or_null(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def regional_price(price: Column, factor: Column) -> Column:
    return half_even(price * F.coalesce(factor, F.lit(1.0)), 4)


def monthly_instance_cost(price: Column, count: Column, hours_per_day: float = 24.0, days: int = 30) -> Column:
    return price * count * F.lit(hours_per_day * days)


def merge_catalog(current: DataFrame, imported: DataFrame, order: str) -> DataFrame:
    """Current prices overridden by imported ones, the last import winning; rows without a key or price are skipped."""
    usable = imported.filter(
        F.col("instance_type").isNotNull() & F.col("provider").isNotNull() & (F.col("hourly_price") >= 0)
    )
    columns = ["vcpus", "memory_gb", "hourly_price"]
    both = current.select("provider", "instance_type", *columns, F.lit(-1).cast("long").alias("_at")).unionByName(
        usable.select("provider", "instance_type", *columns, F.col(order).cast("long").alias("_at"))
    )
    return (
        both.groupBy("provider", "instance_type")
        .agg(F.max_by(F.struct(*columns), "_at").alias("_row"))
        .select("provider", "instance_type", "_row.*")
    )


def priced_with_custom(df: DataFrame, standard: DataFrame, custom: DataFrame) -> DataFrame:
    """Hourly price of (provider, instance_type); a custom price serves only where no standard one exists."""
    keys = ["provider", "instance_type"]
    s = standard.select(*keys, F.col("hourly_price").alias("_standard"))
    c = custom.select(*keys, F.col("hourly_price").alias("_custom"))
    return (
        df.join(s, keys, "left")
        .join(c, keys, "left")
        .withColumn("hourly_price", F.coalesce("_standard", "_custom"))
        .drop("_standard", "_custom")
    )


# Configuration optimisation --------------------------------------------------

MINIMIZE_COST, MINIMIZE_DURATION, BALANCE, BUDGET = (
    "minimize_cost", "minimize_duration", "balance", "budget_constraint",
)


@dataclass(frozen=True)
class Limits:
    """The default constraints of the grid."""

    min_executors: int = 1
    max_executors: int = 100
    min_memory: int = 1024
    max_memory: int = 32768


def candidates(
    goal: Column, executors: Column, memory: Column, limits: Limits = Limits()
) -> list[tuple[Column, Column, Column]]:
    """(allowed, executors, memory) to try, by goal, in order; at most nine. The steps."""
    lean, fast = goal == MINIMIZE_COST, goal == MINIMIZE_DURATION

    def by_goal(cheap: Column, quick: Column, other: Column) -> Column:
        return F.when(lean, cheap).when(fast, quick).otherwise(other)

    few = lambda step: F.greatest(F.lit(1), executors - step)
    small = lambda step: F.greatest(F.lit(1024), memory - step)
    e_range = [
        by_goal(few(2), executors, few(1)),
        by_goal(executors, executors + 2, executors),
        by_goal(executors + 1, executors + 4, executors + 1),
    ]
    m_range = [
        by_goal(small(2048), memory, small(1024)),
        by_goal(memory, memory + 2048, memory),
        by_goal(F.lit(None), F.lit(None), memory + 1024),
    ]
    return [
        (
            e.between(limits.min_executors, limits.max_executors)
            & F.coalesce(m.between(limits.min_memory, limits.max_memory), F.lit(False)),
            e,
            m,
        )
        for e in e_range
        for m in m_range
    ]


def candidate_grid(goal: Column, executors: Column, memory: Column, limits: Limits = Limits()) -> Column:
    """The candidates as an array of struct(executors, memory)."""
    return collected(
        *[
            (ok, F.struct(e.cast("long").alias("executors"), m.cast("long").alias("memory")))
            for ok, e, m in candidates(goal, executors, memory, limits)
        ]
    )


def _improves(new: Column, best: Column, goal: Column) -> Column:
    mixed = (new["cost"] / F.greatest(best["cost"], F.lit(0.01))) * 0.6 + (
        best["rate"] / F.greatest(new["rate"], F.lit(0.01))
    ) * 0.4
    return (
        F.when(goal == MINIMIZE_DURATION, new["rate"] > best["rate"])
        .when(goal == BALANCE, mixed < 1.0)
        .otherwise(new["cost"] < best["cost"])
    )


def optimize(
    runs: DataFrame,
    goal: Column,
    hours: Column,
    budget: Column | None = None,
    provider: Column | None = None,
    limits: Limits = Limits(),
    pricing: Pricing = DEFAULT_PRICING,
) -> DataFrame:
    """Best configuration of every run for its goal, found by an ordered fold over its candidates."""
    executors, memory = F.col("num_executors").cast("long"), F.col("executor_memory_mb").cast("long")

    def option(e: Column, m: Column) -> Column:
        s = Shape(e, F.col("executor_cores"), m, F.col("driver_memory_mb"), F.col("_hours"))
        c, mem, _, _ = cost_parts(s, pricing=pricing).values()
        cost = c + mem
        return F.struct(
            e.alias("executors"), m.alias("memory"), cost.alias("cost"), per_hour(cost, F.col("_hours")).alias("rate")
        )

    rows = runs.withColumns({"_goal": goal, "_hours": hours, "_budget": F.lit(None) if budget is None else budget})
    rows = rows.withColumn("_current", option(executors, memory)).withColumn("_best", F.col("_current"))
    # a budget of zero counts as none
    limit = F.coalesce(F.nullif(F.col("_budget"), F.lit(0.0)), F.lit(float("inf")))
    tries = candidates(F.col("_goal"), executors, memory, limits)
    rows = rows.withColumns(
        {f"_option{i}": F.when(ok, option(e.cast("long"), m.cast("long"))) for i, (ok, e, m) in enumerate(tries)}
    )
    for i in range(len(tries)):
        # one projection per candidate keeps the fold in generated code; a candidate out of bounds is null
        o = F.col(f"_option{i}")
        wins = (o["cost"] <= limit) & _improves(o, F.col("_best"), F.col("_goal"))
        rows = rows.withColumn("_best", F.when(wins, o).otherwise(F.col("_best")))
    rows = rows.drop(*[f"_option{i}" for i in range(len(tries))])
    saved = F.col("_current.cost") - F.col("_best.cost")
    fewer = F.col("_best.executors") < F.col("_current.executors")
    more = F.col("_best.executors") > F.col("_current.executors")
    leaner = F.col("_best.memory") < F.col("_current.memory")
    larger = F.col("_best.memory") > F.col("_current.memory")
    # Texts of advice and trade-offs
    advice = collected(
        (saved > 0, F.concat(F.lit("Potential savings: $"), fixed(saved, 2))),
        (fewer, F.format_string("Reduce executors from %d to %d", "_current.executors", "_best.executors")),
        (
            more,
            F.format_string(
                "Increase executors from %d to %d for better performance", "_current.executors", "_best.executors"
            ),
        ),
        (leaner, F.format_string("Reduce executor memory from %dMB to %dMB", "_current.memory", "_best.memory")),
        (larger, F.format_string("Increase executor memory from %dMB to %dMB", "_current.memory", "_best.memory")),
        (F.col("_goal") == MINIMIZE_COST, F.lit("Consider spot instances for additional savings")),
        (F.col("_goal") == MINIMIZE_DURATION, F.lit("Enable dynamic allocation for peak efficiency")),
    )
    trade_offs = collected(
        (fewer, F.lit("Fewer executors may increase job duration")),
        (leaner, F.lit("Less memory may cause increased spilling or GC pressure")),
    )
    instance = first_or_null(
        matching_instances(F.col("executor_cores"), F.col("_best.memory") / 1024.0, provider)
    )["instance_type"]
    return rows.withColumns(
        {
            "optimized_executors": F.col("_best.executors"),
            "optimized_memory_mb": F.col("_best.memory"),
            "original_cost": F.col("_current.cost"),
            "optimized_cost": F.col("_best.cost"),
            "savings": saved,
            "savings_percent": F.when(
                F.col("_current.cost") > 0, saved / F.col("_current.cost") * 100
            ).otherwise(F.lit(0.0)),
            "recommended_instance": instance,
            "recommendations": advice,
            "trade_offs": trade_offs,
        }
    ).drop("_goal", "_hours", "_budget", "_current", "_best")


def frontier(runs: DataFrame, hours: Column, points: int = 5, pricing: Pricing = DEFAULT_PRICING) -> DataFrame:
    """Points of the cost-duration curve of every run, cheapest first by ``place``."""
    base = F.col("num_executors")
    # Scale steps and the damped effect of more executors on the duration
    scales = [0.5 + i * 0.375 for i in range(points)]

    def point(scale: float) -> Column:
        e = F.greatest(F.lit(1), F.floor(base * F.lit(scale)).cast("long"))
        took = hours * F.lit(1.0 / (0.5 + 0.5 * scale))
        s = Shape(e, F.col("executor_cores"), F.col("executor_memory_mb"), F.col("driver_memory_mb"), took)
        c, m, _, _ = cost_parts(s, pricing=pricing).values()
        return F.struct((c + m).alias("cost"), F.lit(scale).alias("scale"), e.alias("executors"), took.alias("hours"))

    curve = F.sort_array(F.array(*[point(x) for x in scales]))
    return runs.select("app_id", F.posexplode(curve).alias("place", "_p")).select("app_id", "place", "_p.*")


def instance_comparison(runs: DataFrame, catalog: DataFrame, hours: Column, provider: Column, k: int = 10, **how) -> DataFrame:
    """The k cheapest instances of a catalog that fit the executors of a run, with the cost of the run on each."""
    rows = fitting_runs(runs.withColumn("_hours", hours), catalog, k, provider, ["app_id", "num_executors", "_hours"], **how)
    rows = rows.select("app_id", "num_executors", "_hours", F.posexplode("best").alias("place", "_i"))
    cost = F.col("_i.hourly_price") * F.col("num_executors") * F.col("_hours")
    return rows.select(
        "app_id", "place", "_i.instance_type", "_i.vcpus", "_i.memory_gb", "_i.hourly_price",
        half_even(cost, 4).alias("total_cost"),
    )


def spot_strategy(s: Shape, provider: Column, tolerance: Column) -> dict[str, Column]:
    """Spot, mixed or on-demand, from the expected cost of interruptions. 5 % per hour, half a rerun."""
    on_demand = total_cost(s)
    spot = total_cost(s, SPOT, provider)
    interrupted = F.lit(1.0) - F.pow(F.lit(1 - 0.05), s.hours)
    expected = spot * (F.lit(1.0) + interrupted * 0.5)
    saved = on_demand - expected
    strategy = (
        F.when((tolerance >= 0.7) & (saved > 0), "full_spot").when(tolerance >= 0.4, "mixed").otherwise("on_demand")
    )
    tips = collected(
        (strategy != "on_demand", F.lit("Enable checkpointing to handle interruptions")),
        (strategy == "mixed", F.lit("Set spark.dynamicAllocation.enabled=true for flexibility")),
        (strategy == "full_spot", F.lit("Consider using Spot Fleet for better availability")),
    )
    return {
        "strategy": strategy,
        "on_demand_cost": half_even(on_demand, 4),
        "spot_cost": half_even(spot, 4),
        "expected_cost": half_even(expected, 4),
        "expected_savings": half_even(saved, 4),
        "interruption_probability": half_even(interrupted * 100, 1),
        "recommendations": tips,
    }


# Providers -----------------------------------------------------------------


def provider_options(
    s: Shape, pricing: dict[str, Pricing] | None = None, tiers: Sequence[str] = (ON_DEMAND,)
) -> Column:
    """Array of struct(cost, rank_hint, provider, tier) in provider order, cheapest first after array_sort."""
    prices = pricing or {}
    items = []
    for p in cat.PROVIDERS:
        for t in tiers:
            items.append(
                F.struct(
                    total_cost(s, t, p, prices.get(p, DEFAULT_PRICING)).alias("cost"),
                    F.lit(len(items)).alias("position"),
                    F.lit(p).alias("provider"),
                    F.lit(t).alias("tier"),
                )
            )
    return F.array(*items)


def compare_providers(runs: DataFrame, s: Shape, pricing: dict[str, Pricing] | None = None) -> DataFrame:
    """Cheapest and dearest provider of every run, the gap and the ranking."""
    rows = runs.withColumn("_ranked", F.sort_array(provider_options(s, pricing)))
    first, last = F.col("_ranked")[0], F.col("_ranked")[len(cat.PROVIDERS) - 1]
    return rows.select(
        "app_id",
        first["provider"].alias("cheapest_provider"),
        first["cost"].alias("cheapest_cost"),
        last["provider"].alias("most_expensive_provider"),
        last["cost"].alias("most_expensive_cost"),
        (last["cost"] - first["cost"]).alias("savings"),
        F.col("_ranked.provider").alias("ranking"),
    )


def region_costs(runs: DataFrame, s: Shape, with_region_factor: bool = False) -> DataFrame:
    """Cost of a run in each compared region of its provider; the price ignores the region unless asked otherwise."""
    options = F.map_from_arrays(
        F.array(*[F.lit(p) for p in cat.PROVIDERS]),
        F.array(
            *[
                F.array(
                    *[
                        F.struct(F.lit(r).alias("region"), F.lit(cat.REGION_FACTORS[p][r]).alias("factor"))
                        for r in cat.COMPARED_REGIONS[p]
                    ]
                )
                for p in cat.PROVIDERS
            ]
        ),
    )
    factor = F.col("_o.factor") if with_region_factor else F.lit(1.0)
    return (
        runs.withColumn("_cost", total_cost(s))
        .select("app_id", "provider", "_cost", F.explode(options[F.col("provider")]).alias("_o"))
        .select("app_id", "provider", "_o.region", half_even(F.col("_cost") * factor, 4).alias("cost"))
    )


def cheapest_options(runs: DataFrame, s: Shape, spot: bool = True, k: int = 10) -> DataFrame:
    """The k cheapest of all provider, region and tier options of every run, with the number of options."""
    tiers = [ON_DEMAND, SPOT] if spot else [ON_DEMAND]
    # a cost depends on provider and tier only and is computed once for all regions
    rows = runs.withColumns({f"_{p}_{t}": total_cost(s, t, p) for p in cat.PROVIDERS for t in tiers})
    items: list[Column] = []
    for p in cat.PROVIDERS:
        for r in cat.COMPARED_REGIONS[p]:
            for t in tiers:
                items.append(
                    F.struct(
                        F.col(f"_{p}_{t}").alias("cost"),
                        F.lit(len(items)).alias("position"),
                        F.lit(p).alias("provider"),
                        F.lit(r).alias("region"),
                        F.lit(t).alias("tier"),
                    )
                )
    ranked = F.slice(F.sort_array(F.array(*items)), 1, k)
    rows = rows.select("app_id", F.lit(len(items)).alias("total_options_analyzed"), F.posexplode(ranked).alias("place", "_o"))
    return rows.select("app_id", "total_options_analyzed", "place", "_o.provider", "_o.region", "_o.tier", "_o.cost")


def migration(
    current: Column, target: Column, hours: Column, data_gb: Column, egress_per_gb: float = 0.09
) -> dict[str, Column]:
    """What moving a job costs once, what it saves per month, and when it pays back. Texts and limits."""
    egress = data_gb * F.lit(egress_per_gb)
    monthly = F.when(hours > 0, (current - target) * HOURS_PER_MONTH / hours).otherwise(F.lit(0.0))
    months = F.when(monthly > 0, egress / monthly)
    verdict = (
        F.when(monthly <= 0, "Migration not recommended - no cost savings expected")
        .when(months < 3, "Strongly recommended - quick payback period")
        .when(months < 6, "Recommended - reasonable payback period")
        .when(months < 12, "Consider carefully - long payback period")
        .otherwise("Not recommended - payback period exceeds 1 year")
    )
    return {
        "current_job_cost": half_even(current, 4),
        "new_job_cost": half_even(target, 4),
        "job_savings": half_even(current - target, 4),
        "total_migration_cost": half_even(egress, 4),
        "estimated_monthly_savings": half_even(monthly, 4),
        "payback_months": half_even(months, 1),
        "recommendation": verdict,
    }


# Weights of the provider score
DEFAULT_PRIORITIES = {"cost": 0.4, "performance": 0.3, "reliability": 0.3}


def recommend_provider(runs: DataFrame, s: Shape, priorities: dict[str, float] | None = None) -> DataFrame:
    """Provider with the best weighted score of cost, variety of instances and reliability."""
    w = priorities or DEFAULT_PRIORITIES
    scored = []
    for i, p in enumerate(cat.PROVIDERS):
        variety = min(1.0, sum(1 for row in cat.PRICES if row[1] == p) / 20)
        score = (
            F.lit(w["cost"]) * (F.lit(1.0) / (F.lit(1.0) + total_cost(s, ON_DEMAND, p)))
            + F.lit(w["performance"] * variety)
            + F.lit(w["reliability"] * cat.RELIABILITY.get(p, 0.9))
        )
        scored.append(F.struct((-score).alias("minus_score"), F.lit(i).alias("position"), F.lit(p).alias("provider")))
    best = F.array_min(F.array(*scored))
    return runs.select("app_id", best["provider"].alias("recommended_provider"), (-best["minus_score"]).alias("score"))


def monthly_projection(cost: Column, hours: Column) -> dict[str, Column]:
    """Monthly cost at the hourly rate, and at the dashboard's flat spot and reserved shares (fixed values)."""
    month = F.when(hours > 0, cost / hours * HOURS_PER_MONTH).otherwise(F.lit(0.0))
    return {"monthly_on_demand": month, "monthly_spot": month * 0.3, "monthly_reserved": month * 0.6}
