"""Keyed state of live applications: cooldown, metric history, status changes, tuning sessions.

Alerts, status changes, registrations and histories go by event time: rows may come out of order within the delay of
the watermark, later ones are dropped and counted (``feeds.run``), and state goes when it can make no difference any
more or when its application has been silent for long. Sessions go by their own numbering and sort within a batch.

Spark also unpickles a processor in a helper process that does not see the
files shipped to the workers, so this module is pickled by value and its
classes use plain values and functions of this module only.

Where most keys have few rows, a processor takes plain rows: a pandas frame for every key costs far more than its rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobsight.operators import tuning

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOUR_US = 3_600_000_000
IDLE_US = 90 * 24 * HOUR_US
SESSION_CONFIG, TUNABLE = dict(tuning.SESSION_CONFIG), dict(tuning.TUNABLE)
STEP_METRICS, STRATEGIES = dict(tuning.STEP_METRICS), dict(tuning.STRATEGIES)
LOWER_IS_BETTER = list(tuning.LOWER_IS_BETTER)
CONVERGENCE, MAX_ITERATIONS = tuning.CONVERGENCE, tuning.MAX_ITERATIONS


#: Rows that are handed to the state at once.
CHUNK_ROWS = 10_000


def _known(v: Any) -> bool:
    return v is not None and v == v


def _ms_after(us: int) -> int:
    """First millisecond at or after a time; timers and watermarks count in milliseconds."""
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Gives the rows of a key to ``follow`` in the order of (us, event_id), each once the watermark has passed it.

    Rows wait in the state until then, so their order of arrival does not matter as long as they are no later than the
    watermark's delay. Later ones never arrive here: Spark drops and counts them. Rows without a time or an id are left
    out. ``expires`` says from when on the rest of a key's state makes no difference; ``forget`` removes it then.
    """

    waiting_columns: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = {"us": "LONG", "event_id": "LONG", **self.waiting_columns}
        self.waiting = handle.getListState("waiting", ", ".join(f"{k} {v}" for k, v in fields.items()))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, names = None, ["us", "event_id", *self.waiting_columns]
        told = (tuple(row[c] for c in names) for row in rows if row["us"] is not None and row["event_id"] is not None)
        while chunk := list(islice(told, CHUNK_ROWS)):
            self.waiting.appendList(chunk)
            oldest = min(r[0] for r in chunk)
            first = oldest if first is None else min(first, oldest)
        if first is not None:
            self.handle.registerTimer(_ms_after(first))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= passed), key=lambda r: r[:2])
        later = [r for r in rows if r[0] > passed]
        found = []
        if ready:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            found = self.follow(key, ready)
        if later:
            self.handle.registerTimer(_ms_after(min(r[0] for r in later)))
        expiry = self.expires()
        if expiry is not None and expiry <= passed:
            self.forget()
        elif expiry is not None:
            self.handle.registerTimer(_ms_after(expiry))
        yield from found

    def close(self) -> None:
        pass


class Cooldown(InOrder):
    """Lets a trigger through when its key has not fired within the cooldown.

    Of triggers at one time the smallest event fires; without cooldown all do. The last alert is forgotten when its
    cooldown is over, as the next trigger fires with or without it.
    """

    waiting_columns = {"cooldown_us": "LONG"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "us LONG, cooldown_us LONG")

    def follow(self, key: Any, rows: list[tuple]) -> list[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        fired = []
        for us, event_id, cooldown in rows:
            if last is None or us - last >= cooldown:
                fired.append(Row(rule=key[0], app_id=key[1], us=us, event_id=event_id))
                last = us
        if fired:
            self.last.update((last, int(rows[-1][2])))
        return fired

    def expires(self) -> int | None:
        return sum(self.last.get()) if self.last.exists() else None

    def forget(self) -> None:
        self.last.clear()


def cooldown_alerts(triggers: DataFrame) -> DataFrame:
    """Alerts of a stream of triggers (rule, app_id, us, event_id, cooldown_us) that has a watermark."""
    return triggers.groupBy("rule", "app_id").transformWithState(
        statefulProcessor=Cooldown(),
        outputStructType="rule string, app_id string, us long, event_id long",
        outputMode="Append",
        timeMode="EventTime",
    )


class History(StatefulProcessor):
    """Keeps the newest points of a metric, by number and age, and gives the kept ones after every batch.

    The points go once the watermark is past the age of the newest: a point after that would leave none of them.
    """

    def __init__(self, max_points: int = 1000, max_age_us: int = HOUR_US):
        self.max_points, self.max_age_us = max_points, max_age_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "us LONG, event_id LONG, value DOUBLE")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        for chunk in rows:
            chunk = chunk[chunk["us"].notna() & chunk["event_id"].notna()].nlargest(self.max_points, ["us", "event_id"])
            new = zip(chunk["us"].astype("int64").tolist(), chunk["event_id"].astype("int64").tolist(), chunk["value"].tolist())
            kept = sorted([*kept, *new], key=lambda p: p[:2])[-self.max_points :]
        if not kept:
            return
        newest = kept[-1][0]
        kept = [p for p in kept if p[0] > newest - self.max_age_us]
        self.points.put(kept)
        self.handle.registerTimer(_ms_after(newest + self.max_age_us))
        out = pd.DataFrame(kept, columns=["us", "event_id", "value"])
        yield out.assign(app_id=key[0], metric_name=key[1])[["app_id", "metric_name", "us", "event_id", "value"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.points.exists():
            newest = max(p[0] for p in self.points.get())
            if newest + self.max_age_us <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.points.clear()
        return iter([])

    def close(self) -> None:
        pass


def metric_history(points: DataFrame, max_points: int = 1000, max_age_us: int = HOUR_US) -> DataFrame:
    """Kept points (app_id, metric_name, us, event_id, value) of a stream that has a watermark."""
    return points.groupBy("app_id", "metric_name").transformWithStateInPandas(
        statefulProcessor=History(max_points, max_age_us),
        outputStructType="app_id string, metric_name string, us long, event_id long, value double",
        outputMode="Update",
        timeMode="EventTime",
    )


class Registration(StatefulProcessor):
    """A started event at the first sight of an application.

    Who is not seen for ``idle_us`` is forgotten once the watermark has passed that, and is new at the next sight. A
    silence between two rows of one batch is not looked for, so that only the ends of a batch are held.
    """

    def __init__(self, idle_us: int = IDLE_US):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us LONG")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        spans = [(int(t.min()), int(t.max())) for t in (chunk["us"].dropna() for chunk in rows) if len(t)]
        if not spans:
            return
        oldest, newest = min(low for low, _ in spans), max(high for _, high in spans)
        before = self.seen.get()[0] if self.seen.exists() else None
        last = newest if before is None else max(newest, before)
        self.seen.update((last,))
        self.handle.registerTimer(_ms_after(last + self.idle_us))
        if before is None or oldest - before >= self.idle_us:
            yield pd.DataFrame({"user_id": [key[0]], "event": ["application_started"]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[0] + self.idle_us <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def registrations(points: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Started events of a stream of sights (user_id, us) that has a watermark."""
    return points.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=Registration(idle_us),
        outputStructType="user_id long, event string",
        outputMode="Append",
        timeMode="EventTime",
    )


class StatusChanges(InOrder):
    """Emits a row where the status of an application changes; a new application is running.

    An application that gives no status for ``idle_us`` is new again.
    """

    waiting_columns = {"status": "STRING"}

    def __init__(self, idle_us: int = IDLE_US):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.status = handle.getValueState("status", "status STRING, us LONG")

    def follow(self, key: Any, rows: list[tuple]) -> list[Row]:
        status, last = self.status.get() if self.status.exists() else ("running", rows[0][0])
        changes = []
        for us, event_id, new in rows:
            if new is None:
                continue
            if us - last >= self.idle_us:
                status = "running"
            if new != status:
                changes.append(Row(user_id=key[0], event_id=event_id, old_status=status, new_status=new))
            status, last = new, us
        self.status.update((status, last))
        return changes

    def expires(self) -> int | None:
        return self.status.get()[1] + self.idle_us if self.status.exists() else None

    def forget(self) -> None:
        self.status.clear()


def status_changes(updates: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """Changes of a stream of updates (user_id, event_id, us, status) that has a watermark."""
    return updates.groupBy("user_id").transformWithState(
        statefulProcessor=StatusChanges(idle_us),
        outputStructType="user_id long, event_id long, old_status string, new_status string",
        outputMode="Append",
        timeMode="EventTime",
    )


_CONFIG = list(SESSION_CONFIG)
_STATE = "status STRING, iterations INT, best_value DOUBLE, adjustments INT, " + ", ".join(f"{c} DOUBLE" for c in _CONFIG)


class TuningSession(StatefulProcessor):
    """One tuning session: every iteration updates the best value, may end the session, and moves the configuration."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        place = lambda v: (v is None, 0 if v is None else v)
        batch = sorted((row.asDict() for row in rows), key=lambda r: (place(r["seq"]), place(r["tie"])))
        kept = self.state.get() if self.state.exists() else None
        if kept is not None:
            status, iterations, best, steps, *values = kept
            cfg = dict(zip(_CONFIG, values))
        else:
            status, iterations, best, steps = "active", 0, None, 0
            given = next((r for r in batch if _known(r["target"])), {})
            cfg = {c: float(given[c]) if _known(given.get(c)) else TUNABLE[p][0] for c, p in SESSION_CONFIG.items()}
        for row in batch:
            if status != "active" or not _known(row["target"]):
                continue
            x, lower = row["target"], any(m in row["target_metric"].lower() for m in LOWER_IS_BETTER)
            better = best is not None and (x < best if lower else x > best)
            converged = better and abs(x - best) / max(abs(best), 1.0) < CONVERGENCE
            best = x if best is None or better else best
            iterations += 0 if converged else 1
            if converged or iterations >= MAX_ITERATIONS:
                status = "completed"
                continue
            moved = next_config(cfg, row)
            steps += sum(moved[c] != cfg[c] for c in _CONFIG)
            cfg = moved
        self.state.update((status, iterations, best, steps, *[cfg[c] for c in _CONFIG]))
        yield Row(session=key[0], status=status, iterations=iterations, best_value=best, adjustments=steps)

    def close(self) -> None:
        pass


def next_config(cfg: dict[str, float], row: dict[str, Any]) -> dict[str, float]:
    """Configuration after the steps one set of metrics asks for."""

    def metric(name: str) -> float:
        v = row.get(name)
        return STEP_METRICS[name] if v is None or v != v else v

    def span(column: str) -> tuple[float, float, float]:
        _, low, high, step, _ = TUNABLE[SESSION_CONFIG[column]]
        return low, high, step

    factor = STRATEGIES[row["strategy"]]
    raise_if = {
        "executor_memory": metric("memory_spill_ratio") > 0.1 or metric("disk_spill_bytes") > 0,
        "parallelism": metric("cpu_utilization") < 50,
        "shuffle_partitions": metric("shuffle_spill_ratio") > 0.2,
    }
    out = dict(cfg)
    for column, wanted in raise_if.items():
        if wanted:
            _, high, step = span(column)
            out[column] = min(cfg[column] + int(step * factor), high)
    if metric("gc_time_percent") > 10:
        low, _, step = span("memory_fraction")
        out["memory_fraction"] = round(max(cfg["memory_fraction"] - step * factor, low), 2)
    if metric("task_failure_rate") > 0.05:
        low, _, step = span("executor_cores")
        out["executor_cores"] = max(cfg["executor_cores"] - int(step * factor), low)
    if row["target_metric"] == "cost" and metric("task_throughput") > 0 and metric("task_failure_rate") < 0.01:
        out["executor_instances"] = max(cfg["executor_instances"] - 1, span("executor_instances")[0])
    return out


def tuning_sessions(iterations: DataFrame) -> DataFrame:
    return iterations.groupBy("session").transformWithState(
        statefulProcessor=TuningSession(),
        outputStructType="session long, status string, iterations int, best_value double, adjustments int",
        outputMode="Update",
        timeMode="None",
    )
