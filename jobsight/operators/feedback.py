"""Feedback on tuning changes and the patterns learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobsight.operators.ordered import with_running
from jobsight.session import stored

# Metrics that are better when lower; smallest sample, full sample, least confidence of a pattern
LOWER = ["duration", "cost", "gc_time", "latency"]
MIN_SAMPLE, FULL_SAMPLE, MIN_CONFIDENCE = 5, 20, 0.6


def improvement(metric: Column, before: Column, after: Column) -> Column:
    """Percent gained, in the direction of the metric; 0 when the value before was 0."""
    b, a = before.cast("double"), after.cast("double")
    gained = F.when(metric.isin(*LOWER), b - a).otherwise(a - b)
    return F.when(b != 0, gained / F.nullif(b, F.lit(0.0)) * 100).otherwise(F.lit(0.0))


def scored(feedback: DataFrame) -> DataFrame:
    """Add actual_improvement and success: any gain, or at least half of what was expected."""
    actual = improvement(F.col("metric_name"), F.col("metric_before"), F.col("metric_after"))
    expected = F.col("expected_improvement")
    return feedback.withColumn("actual_improvement", actual).withColumn(
        "success",
        (F.col("actual_improvement") > 0) | ((expected > 0) & (F.col("actual_improvement") >= expected * 0.5)),
    )


def config_key(config: Column) -> Column:
    """Stable text of a settings map: key_value pairs in key order."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(e["key"], F.lit("_"), e["value"])), "-"
    )


def inferred_condition(metric: Column, before: Column) -> Column:
    """When to use a pattern again: the metric is about as bad as it was (fixed values: 80 % and 120 %)."""
    b = before.cast("double")
    low = metric.isin(*LOWER)
    return F.struct(
        metric.alias("metric"),
        F.when(low, "gt").otherwise("lt").alias("operator"),
        F.when(low, b * 0.8).otherwise(b * 1.2).alias("threshold"),
    )


def confidence(successes: Column, total: Column) -> Column:
    rate = successes.cast("double") / F.nullif(total, F.lit(0))
    grown = rate * F.least(F.lit(1.0), total / float(FULL_SAMPLE))
    return F.when(total < MIN_SAMPLE, F.lit(0.0)).otherwise(grown)


def learn(observed: DataFrame, key: str, order: Column) -> DataFrame:
    """One pattern per configuration key, its condition taken from the first observation."""
    first = inferred_condition(F.col("metric_name"), F.col("metric_before"))
    grouped = observed.groupBy(key).agg(
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.avg("actual_improvement").alias("avg_improvement"),
        F.min_by(first, order).alias("condition"),
    )
    total = F.col("success_count") + F.col("failure_count")
    return grouped.withColumns(
        {
            "samples": total,
            "success_rate": F.col("success_count") / total,
            "confidence": confidence(F.col("success_count"), total),
        }
    )


def usable(patterns: DataFrame, min_samples: int = MIN_SAMPLE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    return patterns.filter((F.col("samples") >= min_samples) & (F.col("confidence") >= min_confidence))


def statistics(observed: DataFrame, patterns: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    facts = observed.agg(
        F.count(F.lit(1)).alias("total_feedback"),
        (F.count_if("success") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("success_rate"),
        F.avg("actual_improvement").alias("avg_improvement"),
    )
    learned = patterns.agg(
        F.count(F.lit(1)).alias("patterns_learned"),
        F.count_if(F.col("confidence") >= min_confidence).alias("high_confidence_patterns"),
    )
    one = F.lit(1).alias("_one")
    return facts.select("*", one).join(learned.select("*", one), "_one").drop("_one").fillna(0.0)


def running_improvement(observed: DataFrame, key: str, order: list[str], block: Column | None = None) -> DataFrame:
    """Mean improvement of a pattern after every observation; stays parallel when one pattern is very common."""
    rows = with_running(
        observed,
        [key],
        block,
        order,
        {"_sum": ("sum", F.col("actual_improvement")), "observations": ("sum", F.lit(1))},
    )
    return rows.withColumn("mean_improvement", F.col("_sum") / F.col("observations")).drop("_sum")


def holds(operator: Column, value: Column, threshold: Column) -> Column:
    """value operator threshold; an unknown operator does not hold."""
    return (
        F.when(operator == "gt", value > threshold)
        .when(operator == "gte", value >= threshold)
        .when(operator == "lt", value < threshold)
        .when(operator == "lte", value <= threshold)
        .when(operator == "eq", value == threshold)
        .when(operator == "neq", value != threshold)
        .otherwise(F.lit(False))
    )


def undominated(patterns: DataFrame, key: str) -> DataFrame:
    """Patterns that can still be the best answer for some value.

    Of two one-sided conditions on the same metric, the stricter one with no better confidence never wins.
    """
    up = F.col("condition.operator").isin("gt", "gte")
    strict = F.when(up, F.col("condition.threshold")).otherwise(-F.col("condition.threshold"))
    rank = F.struct((-F.col("confidence")).alias("c"), F.col(key).alias("k"))
    # strict and non-strict comparisons stay apart, so the thresholds of a group can be compared
    weaker = (
        W.partitionBy("condition.metric", "condition.operator")
        .orderBy("_strict")
        .rangeBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        patterns.withColumns({"_strict": strict, "_rank": rank})
        .withColumn("_best", F.min("_rank").over(weaker))
        .filter((F.col("_rank") == F.col("_best")) | (F.col("condition.operator") == "eq"))
        .drop("_strict", "_rank", "_best")
    )


def learn_conditions(observed: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, conditions): one condition per metric of the pattern's feedback, each from the first observation of it."""
    first = inferred_condition(F.col("metric_name"), F.col("metric_before"))
    each = observed.groupBy(key, "metric_name").agg(F.min_by(first, order).alias("condition"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list("condition")).alias("conditions"))


def _steps(points: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Thresholds of every (metric, operator) in order from the one that is met first, and how many each value meets.

    ``points`` are (metric, value), ``conditions`` (metric, operator, threshold). Returns (metric, operator, threshold, step)
    and (metric, value, operator, passed): the condition holds where passed >= step, for eq where they are equal and for
    neq where they are not. Values and thresholds are put into one order, in blocks of bounded size; a value meets what
    lies before it, so no value is compared with a threshold.
    """
    wanted = conditions.select("metric", "operator", "threshold").distinct()
    kinds = wanted.select("metric", "operator").distinct()
    asked = points.select("metric", "value").filter("value IS NOT NULL").distinct().join(kinds, "metric")
    sign = F.when(F.col("operator").isin("lt", "lte"), -1.0).otherwise(1.0)
    # A value equal to a threshold comes before it where equality does not meet the condition.
    late = F.col("operator").isin("gt", "lt")
    thresholds = wanted.select("metric", "operator", F.col("threshold").alias("own"), (F.col("threshold") * sign).alias("at"), F.when(late, 2).otherwise(0).alias("tie"), F.lit(1).alias("is_threshold"))
    values = asked.select("metric", "operator", F.col("value").alias("own"), (F.col("value") * sign).alias("at"), F.lit(1).alias("tie"), F.lit(0).alias("is_threshold"))
    placed = with_running(thresholds.unionByName(values), ["metric", "operator"], None, ["at", "tie"], {"passed": ("sum", F.col("is_threshold"))})
    placed = stored(placed, "steps")
    steps = placed.filter("is_threshold = 1").select("metric", "operator", F.col("own").alias("threshold"), F.col("passed").alias("step"))
    passed = placed.filter("is_threshold = 0").select("metric", F.col("own").alias("value"), "operator", "passed")
    equal = steps.select("metric", "operator", F.col("threshold").alias("value"), F.lit(True).alias("met_equal"))
    passed = passed.join(equal, ["metric", "operator", "value"], "left")
    exact = F.col("operator").isin("eq", "neq")
    return steps, passed.select("metric", "value", "operator", F.when(exact & F.col("met_equal").isNull(), 0).otherwise(F.col("passed")).alias("passed"))


def matched(metrics: DataFrame, patterns: DataFrame, key: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Patterns all of whose conditions hold, by relational division: (cell, key) pairs, and (id, cell) of every row.

    ``metrics`` has an id and a map of metrics, ``patterns`` a key and ``conditions``, an array of (metric, operator,
    threshold). Rows whose metrics meet the same thresholds are one cell, so patterns are matched with cells and not with
    rows. A metric that a row lacks meets no condition; a pattern without conditions fits every row.
    """
    conditions = patterns.select(F.col(key), F.size("conditions").alias("_needed"), F.inline("conditions")).distinct()
    points = metrics.select(id_column, F.explode("metrics").alias("metric", "value")).filter("value IS NOT NULL")
    steps, passed = _steps(points, conditions)
    ranked = conditions.join(steps, ["metric", "operator", "threshold"])
    met = points.join(passed, ["metric", "value"])
    own = met.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("metric", "operator", "passed"))).alias("cell"))
    empty = F.array().cast(own.schema["cell"].dataType)
    cells = stored(metrics.select(id_column).join(own, id_column, "left").withColumn("cell", F.coalesce("cell", empty)), "cells")
    different = cells.select("cell").distinct()
    operator, passes, step = F.col("operator"), F.col("passed"), F.col("step")
    hold = F.when(operator == "eq", passes == step).when(operator == "neq", passes != step).otherwise(passes >= step)
    pairs = different.select("cell", F.inline("cell")).join(ranked, ["metric", "operator"]).filter(hold)
    full = pairs.groupBy("cell", key, "_needed").agg(F.count(F.lit(1)).alias("_met")).filter("_met = _needed").select("cell", key)
    always = patterns.filter(F.size("conditions") == 0).agg(F.collect_list(key).alias("_keys")).select("_keys", F.lit(1).alias("_one"))
    every = different.withColumn("_one", F.lit(1)).join(always, "_one").select("cell", F.explode("_keys").alias(key))
    return full.unionByName(every), cells


def recommend(metrics: DataFrame, patterns: DataFrame, key: str, id_column: str) -> DataFrame:
    """Best usable pattern for every row of metrics (id, metrics map): all its conditions must hold.

    Patterns of one condition that a weaker and better one always beats are left out first; the rest is matched with
    cells of rows, and every cell has one best pattern.
    """
    if "conditions" not in patterns.columns:
        patterns = undominated(patterns, key).withColumn("conditions", F.array("condition"))
    pairs, cells = matched(metrics, patterns, key, id_column)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col(key).alias("p"))).alias("_b")
    answers = pairs.join(patterns.select(key, "confidence"), key).groupBy("cell").agg(best)
    return cells.join(answers, "cell").select(id_column, F.col("_b.p").alias(key), (-F.col("_b.c")).alias("confidence"))
