"""Alert rules, triggers, cooldown and the life of an alert."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.functions.numeric import fixed
from jobsight.operators.feedback import holds


@dataclass(frozen=True)
class AlertRule:
    """Templates may use {value} and {threshold} with the formats .0f, .1f, .2f and .1%."""

    name: str
    metric_name: str
    condition: str
    threshold: float
    severity: str
    title: str
    message: str
    cooldown_minutes: float = 5
    enabled: bool = True


# The default rules
DEFAULT_RULES = (
    AlertRule("high_gc_time", "jvm_gc_time_percent", "gt", 10.0, "warning", "High GC Time",
              "GC time is {value:.1f}%, exceeding {threshold}% threshold"),
    AlertRule("critical_gc_time", "jvm_gc_time_percent", "gt", 25.0, "critical", "Critical GC Time",
              "GC time is critically high at {value:.1f}%"),
    AlertRule("memory_spilling", "memory_spill_ratio", "gt", 0.1, "warning", "Memory Spilling Detected",
              "Memory spill ratio is {value:.2f}, data is spilling to disk"),
    AlertRule("high_task_failure_rate", "task_failure_rate", "gt", 0.05, "error", "High Task Failure Rate",
              "Task failure rate is {value:.1%}, exceeding {threshold:.1%}"),
    AlertRule("executor_lost", "executors_lost", "gt", 0.0, "error", "Executor Lost",
              "{value:.0f} executor(s) have been lost"),
    AlertRule("low_cpu_utilization", "cpu_utilization", "lt", 30.0, "info", "Low CPU Utilization",
              "CPU utilization is only {value:.1f}%, resources may be over-provisioned"),
    AlertRule("high_shuffle_spill", "shuffle_spill_ratio", "gt", 0.2, "warning", "High Shuffle Spill",
              "Shuffle spill ratio is {value:.2f}, consider increasing executor memory"),
)


def rule_table(spark: SparkSession, rules: Sequence[AlertRule] = DEFAULT_RULES) -> DataFrame:
    """The enabled rules as a small table."""
    rows = [
        (r.name, r.metric_name, r.condition, float(r.threshold), r.severity, int(r.cooldown_minutes * 60_000_000))
        for r in rules
        if r.enabled
    ]
    return spark.createDataFrame(
        rows, "rule string, metric_name string, condition string, threshold double, severity string, cooldown_us long"
    )


def without_rule(rules: Sequence[AlertRule], name: str) -> tuple[AlertRule, ...]:
    return tuple(r for r in rules if r.name != name)


_FIELD = re.compile(r"\{(value|threshold)(?::\.(\d)([f%]))?\}")


def rendered(template: str, value: Column, threshold: Column) -> Column:
    """Template filled in as a column; a share given in percent is multiplied by 100."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        source = value if m.group(1) == "value" else threshold
        parts.append(F.lit(template[at : m.start()]))
        if m.group(2) is None:
            parts.append(source.cast("string"))
        elif m.group(3) == "%":
            parts += [fixed(source * 100, int(m.group(2))), F.lit("%")]
        else:
            parts.append(fixed(source, int(m.group(2))))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def with_texts(triggers: DataFrame, rules: Sequence[AlertRule] = DEFAULT_RULES) -> DataFrame:
    """Add title and message of the rule."""
    title, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in rules:
        mine = F.col("rule") == r.name
        title = F.when(mine, rendered(r.title, F.col("value"), F.col("threshold"))).otherwise(title)
        message = F.when(mine, rendered(r.message, F.col("value"), F.col("threshold"))).otherwise(message)
    return triggers.withColumns({"title": title, "message": message})


def triggers(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Points that meet a rule, one row per point and rule."""
    joined = points.join(rules, "metric_name")
    met = joined.filter(holds(F.col("condition"), F.col("value"), F.col("threshold")))
    return met.withColumn("us", F.unix_micros("ts"))


# Cooldown ----------------------------------------------------------------------
#
# A trigger fires when its key has not fired within the cooldown before it, so
# firing depends on the last trigger that fired. The time of a key is cut into
# blocks many cooldowns long. Only the last fire before a block matters for it,
# and only the triggers of its first cooldown can be suppressed by that. So a
# block is summed up as "from this entry on, the last fire is that", the blocks
# of a key are chained over these short summaries, and every block is then
# resolved on its own with its entry known.

BLOCK_COOLDOWNS = 64


def _chain(times: np.ndarray, cooldown: int) -> np.ndarray:
    """Index of the next trigger that may fire after each trigger has fired."""
    return np.searchsorted(times, times + cooldown, side="left")


def _summary(keys: Sequence[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["us"].to_numpy(dtype="int64"))
        cooldown = int(pdf["cooldown_us"].iloc[0])
        block = int(pdf["_block"].iloc[0])
        following = _chain(times, cooldown)
        last = np.empty(len(times), dtype="int64")
        for i in range(len(times) - 1, -1, -1):
            last[i] = times[i] if following[i] >= len(times) else last[following[i]]
        entries = min(np.searchsorted(times, block * cooldown * BLOCK_COOLDOWNS + cooldown, side="left") + 1, len(times))
        # neighbouring entries that end alike are one
        keep = np.append(last[: entries - 1] != last[1:entries], True)
        out = pd.DataFrame({"_entry": times[:entries][keep], "_exit": last[:entries][keep]})
        for k in [*keys, "cooldown_us", "_block"]:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "cooldown_us", "_block", "_entry", "_exit"]]

    return run


def _openings(keys: Sequence[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_block", "_entry"])
        cooldown = int(pdf["cooldown_us"].iloc[0])
        allowed, rows = np.iinfo("int64").min, []
        for block, part in pdf.groupby("_block", sort=True):
            rows.append((block, allowed))
            at = np.searchsorted(part["_entry"].to_numpy(), allowed, side="left")
            if at < len(part):
                allowed = int(part["_exit"].iloc[at]) + cooldown
        out = pd.DataFrame(rows, columns=["_block", "_allowed"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "_block", "_allowed"]]

    return run


def _fires(keys: Sequence[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("us", ignore_index=True)
        times = pdf["us"].to_numpy(dtype="int64")
        following = _chain(times, int(pdf["cooldown_us"].iloc[0]))
        at, fired = int(np.searchsorted(times, int(pdf["_allowed"].iloc[0]), side="left")), []
        while at < len(times):
            fired.append(at)
            at = int(following[at])
        return pdf.iloc[fired][[*keys, "us", "event_id"]]

    return run


def cooled_down(found: DataFrame, keys: Sequence[str] = ("rule", "app_id")) -> DataFrame:
    """The triggers that fire: (keys, us, event_id). Of triggers at the same time the smallest event fires.

    A rule without cooldown fires at every trigger, also at those of the same time.
    """
    keys = list(keys)
    every = found.filter(F.col("cooldown_us") <= 0).select(*keys, "us", "event_id")
    once = found.filter(F.col("cooldown_us") > 0)
    once = once.groupBy(*keys, "cooldown_us", "us").agg(F.min("event_id").alias("event_id"))
    blocked = once.withColumn("_block", F.floor(F.col("us") / (F.col("cooldown_us") * BLOCK_COOLDOWNS)).cast("long"))
    fields = {f.name: f for f in blocked.schema.fields}
    key_fields = [fields[k] for k in keys]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    summary = blocked.groupBy(*keys, "_block").applyInPandas(
        _summary(keys), T.StructType(key_fields + longs("cooldown_us", "_block", "_entry", "_exit"))
    )
    openings = summary.groupBy(*keys).applyInPandas(
        _openings(keys), T.StructType(key_fields + longs("_block", "_allowed"))
    )
    ready = blocked.join(openings, [*keys, "_block"])
    cooled = ready.groupBy(*keys, "_block").applyInPandas(
        _fires(keys), T.StructType(key_fields + longs("us", "event_id"))
    )
    return cooled.unionByName(every.withColumns({c: F.col(c).cast("long") for c in ("us", "event_id")}))


# Life of an alert -----------------------------------------------------------------


def alert_id(rule: Column, event_id: Column) -> Column:
    return F.concat(F.lit("alert-"), rule, F.lit("-"), event_id.cast("string"))


def lifecycle(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with their first acknowledgement and first resolution (alert_id, kind, at_us, by)."""
    at = F.col("at_us")
    state = actions.groupBy("alert_id").agg(
        F.min(F.when(F.col("kind") == "acknowledge", at)).alias("acknowledged_us"),
        F.min_by("by", F.when(F.col("kind") == "acknowledge", F.struct("at_us", "by"))).alias("acknowledged_by"),
        F.min(F.when(F.col("kind") == "resolve", at)).alias("resolved_us"),
    )
    return alerts.join(state, "alert_id", "left")


def active(alerts: DataFrame, app_id: str | None = None) -> DataFrame:
    rows = alerts.filter(F.col("resolved_us").isNull())
    rows = rows if app_id is None else rows.filter(F.col("app_id") == app_id)
    return rows.orderBy(F.desc("us"), "alert_id")


def alert_history(
    alerts: DataFrame, app_id: str | None = None, since_us: int | None = None, limit: int = 100
) -> DataFrame:
    rows = alerts.filter(F.col("resolved_us").isNotNull())
    if app_id is not None:
        rows = rows.filter(F.col("app_id") == app_id)
    if since_us is not None:
        rows = rows.filter(F.col("us") > since_us)
    return rows.orderBy(F.desc("us"), "alert_id").limit(limit)
