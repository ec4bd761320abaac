"""Runs closest to a given one.

``nearest_by_size`` ranks by the size ratio alone, which is a one-dimensional
order: the best k of a request are among the k next smaller and the k next
larger distinct sizes. Every distinct size gets its global rank, a request
looks up 2k ranks, and no pair beyond those is ever formed, however many runs
share a size.

``top_similar`` ranks by a score over several columns against a table of targets.
Candidates lie in blocks and targets in chunks along one number of theirs, the
lead. A chunk first meets the block around its own leads, which gives every
target a k-th best score; then only the blocks that could hold a better one,
by a bound on the score from the leads. Nothing but block counts reaches the
driver, and every task holds one block and one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.functions.similarity import DEFAULT_WEIGHTS, magnitude_similarity
from jobsight.session import stored

#: Targets of a chunk, candidates of a block, and meetings up to which bounds would cost more rounds than they save.
MAX_TARGETS_PER_PASS, BLOCK_ROWS, FEW_MEETINGS = 1000, 16_384, 64


def _bucket(column: str, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds are at or below the value, as a search tree of comparisons."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) < F.lit(float(bounds[middle])), search(low, middle)).otherwise(
            search(middle + 1, high)
        )

    return search(0, len(bounds))


def _buckets(spark: SparkSession) -> int:
    """Two buckets per core, so ranking uses the whole cluster."""
    return max(16, min(1000, 2 * spark.sparkContext.defaultParallelism))


def ranked_sizes(sizes: DataFrame, column: str, buckets: int) -> tuple[DataFrame, list[float], DataFrame]:
    """(sizes with global rank from 0, bucket bounds, first rank per bucket) of distinct sizes.

    Approximate quantiles cut the order into buckets, ranks are counted inside
    each bucket and shifted by the rows of the buckets before it.
    """
    cuts = sizes.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.001)
    bounds = sorted(set(cuts))
    in_bucket = sizes.withColumn("_bucket", _bucket(column, bounds))
    per_bucket = in_bucket.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket, also for the empty ones: few enough for one task to order
    every = sizes.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_bucket"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = every.join(per_bucket, "_bucket", "left").select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(column)) - 1
    ranked = in_bucket.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    return ranked.withColumn("rank", F.col("_place") + F.col("_offset")).drop("_place", "_offset", "_bucket"), bounds, offsets


def nearest_by_size(
    requests: DataFrame,
    history: DataFrame,
    columns: Sequence[str],
    k: int = 5,
    threshold: float = 0.7,
    newest: str = "end_time",
    key: str = "app_id",
    buckets: int | None = None,
) -> DataFrame:
    """For every distinct ``input_bytes`` of the requests, the k most similar runs as a sorted array ``matches``.

    Ties go to the newest run, then to the smallest key. Sizes without a match have no row.
    """
    runs = history.filter(F.col("input_bytes").isNotNull())
    of_size = W.partitionBy("input_bytes").orderBy(F.col(newest).desc_nulls_last(), key)
    best = runs.withColumn("_n", F.row_number().over(of_size)).filter(F.col("_n") <= k)
    # of each size only the k newest can ever be among the best k
    by_size = stored(
        best.groupBy("input_bytes").agg(
            F.collect_list(F.struct(F.unix_micros(newest).alias("at"), *columns)).alias("runs")
        ),
        "sizes",
    )
    ranked, bounds, offsets = ranked_sizes(by_size, "input_bytes", buckets or _buckets(history.sparkSession))

    wanted = requests.select("input_bytes").filter(F.col("input_bytes").isNotNull()).distinct()
    marks = wanted.select("input_bytes", F.lit(0).alias("_is_run")).unionByName(
        by_size.select("input_bytes", F.lit(1).alias("_is_run"))
    )
    # a request comes before the run of its own size, so its position is the rank of that size
    ordered = W.partitionBy("_bucket").orderBy("input_bytes", "_is_run").rowsBetween(W.unboundedPreceding, W.currentRow)
    positions = (
        marks.withColumn("_bucket", _bucket("input_bytes", bounds))
        .withColumn("_seen", F.sum("_is_run").over(ordered))
        .filter(F.col("_is_run") == 0)
    )
    looked_up = positions.join(F.broadcast(offsets), "_bucket").select(
        F.col("input_bytes").alias("wanted_bytes"),
        F.explode(
            F.sequence(F.col("_seen") + F.col("_offset") - k, F.col("_seen") + F.col("_offset") + (k - 1))
        ).alias("rank"),
    )
    score = magnitude_similarity(F.col("wanted_bytes"), F.col("input_bytes"))
    scored = (
        looked_up.join(ranked, "rank")
        .withColumn("score", score)
        .filter(F.col("score") >= threshold)
        .select("wanted_bytes", "score", F.inline("runs"))
    )
    order = F.struct((-F.col("score")).alias("s"), (-F.coalesce("at", F.lit(0))).alias("t"), F.col(key))
    # at most 2k sizes with k runs each come together here
    return (
        scored.groupBy("wanted_bytes")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), "score", *columns))), 1, k).alias("matches"))
        .withColumnRenamed("wanted_bytes", "input_bytes")
    )


# Scores over several columns -----------------------------------------------------


def _bigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 2] for i in range(len(text) - 1))


def _names(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.8
    ga, gb = _bigrams(a), _bigrams(b)
    return len(ga & gb) / len(ga | gb) if ga | gb else 1.0


def _ratio(values: np.ndarray, target: float) -> np.ndarray:
    low, high = np.minimum(values, target), np.maximum(values, target)
    return np.where(high == 0, 1.0, np.divide(low, high, out=np.zeros(len(values)), where=high != 0))


WEIGHTED_COLUMNS = [
    "input_bytes", "app_name", "total_stages", "num_executors", "executor_cores", "executor_memory_mb",
    "shuffle_write_bytes", "output_bytes",
]


@dataclass(frozen=True)
class Scorer:
    """A score of candidates for a target, and what it can be at most.

    ``prepare`` takes a batch of candidates and returns the scores of all of them for one target. ``lead`` is the number
    along which rows are dealt out, and ``bound(x, low, high)`` at least the score of a target with lead x for any
    candidate with a lead from low to high.
    """

    prepare: Callable[[pd.DataFrame], Callable[[dict], np.ndarray]]
    lead: Column
    bound: Callable[[float, float, float], float]


def weighted_scores(weights: dict[str, float] | None = None) -> Scorer:
    """Weighted similarity of a batch of runs to one target; dimensions missing on either side do not count."""
    w = weights or DEFAULT_WEIGHTS
    dims = [
        ("input_size", ["input_bytes"]),
        ("app_name", ["app_name"]),
        ("num_stages", ["total_stages"]),
        ("executor_config", ["num_executors", "executor_cores", "executor_memory_mb"]),
        ("shuffle_size", ["shuffle_write_bytes"]),
        ("output_size", ["output_bytes"]),
    ]

    def prepare(batch: pd.DataFrame) -> Callable[[dict], np.ndarray]:
        numbers = {c: batch[c].to_numpy(dtype="float64") for c in WEIGHTED_COLUMNS if c != "app_name"}
        codes, distinct = pd.factorize(batch["app_name"])
        known = {name: batch[columns].notna().all(axis=1).to_numpy() for name, columns in dims}

        def score(target: dict) -> np.ndarray:
            total, weight = np.zeros(len(batch)), np.zeros(len(batch))
            for name, columns in dims:
                if any(target[c] is None for c in columns):
                    continue
                if name == "app_name":
                    value = np.array([_names(target["app_name"], n) for n in distinct] + [0.0])[codes]
                else:
                    parts = [_ratio(numbers[c], float(target[c])) for c in columns]
                    value = parts[0] if len(parts) == 1 else (parts[0] + parts[1] + parts[2]) / 3
                total += np.where(known[name], value * w[name], 0.0)
                weight += np.where(known[name], w[name], 0.0)
            return np.divide(total, weight, out=np.zeros(len(batch)), where=weight > 0)

        return score

    def bound(x: float, low: float, high: float) -> float:
        # Only the size is bounded; everything else may agree.
        nearest = min(max(x, low), high)
        small, large = min(x, nearest), max(x, nearest)
        ratio = 1.0 if large == small else small / large
        return 1.0 - w["input_size"] * (1.0 - ratio) / sum(w.values())

    return Scorer(prepare, F.col("input_bytes").cast("double"), bound)


def vector_scores(method: str = "cosine") -> Scorer:
    """Cosine similarity or 1 / (1 + Euclidean distance) of column ``vector``. Fixed value: 1e-10 guards the norms."""
    if method not in ("cosine", "euclidean"):
        raise ValueError(f"unknown similarity method {method}")

    def prepare(batch: pd.DataFrame) -> Callable[[dict], np.ndarray]:
        m = np.stack(batch["vector"].to_numpy()).astype("float64")
        unit = m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-10)

        def score(target: dict) -> np.ndarray:
            v = np.asarray(target["vector"], dtype="float64")
            if method == "euclidean":
                return 1.0 / (1.0 + np.sqrt(((m - v) ** 2).sum(axis=1)))
            return unit @ (v / (np.sqrt((v * v).sum()) + 1e-10))

        return score

    def bound(x: float, low: float, high: float) -> float:
        # Vectors are no nearer than their lengths are; directions are not bounded by lengths.
        return 1.0 / (1.0 + max(low - x, x - high, 0.0)) if method == "euclidean" else np.inf

    square = F.aggregate(F.transform("vector", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    return Scorer(prepare, F.sqrt(square), bound)


def _along(rows: DataFrame, lead: Column, key: str, parts: int, name: str) -> DataFrame:
    """``rows`` with ``lead`` and ``name``, the number of one of ``parts`` ranges of it."""
    return stored(rows.withColumn("lead", lead).repartitionByRange(parts, "lead", key).withColumn(name, F.spark_partition_id()), name)


def top_similar(
    candidates: DataFrame,
    targets: DataFrame,
    columns: Sequence[str],
    score: Scorer,
    k: int = 5,
    key: str = "app_id",
    digits: int = 9,
) -> DataFrame:
    """(target, candidate, score, place): the k best candidates of every target, itself left out.

    Scores are rounded before they are ranked, ties go to the smallest key. A row without a lead is bounded by nothing.
    """
    id_type = candidates.schema[key].dataType
    found = T.StructType([T.StructField("target", id_type), T.StructField("candidate", id_type), T.StructField("score", T.DoubleType())])
    rows, wanted = stored(candidates.select(key, *columns), "candidates"), stored(targets.select(key, *columns), "targets")
    n_blocks, n_chunks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-wanted.count() // MAX_TARGETS_PER_PASS))
    search = _best_of_block(score.prepare, score.bound, k, key, digits)
    order = W.partitionBy("target").orderBy(F.desc("score"), "candidate")
    place = F.row_number().over(order).cast("long")
    if n_blocks * n_chunks <= FEW_MEETINGS:
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        hashed = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        nothing = {c: F.lit(None).cast("double") for c in ("lead", "low", "high", "least")}
        left = wanted.withColumns({"chunk": hashed(n_chunks), **nothing}).withColumn("block", each(n_blocks))
        right = rows.withColumn("block", hashed(n_blocks)).withColumn("chunk", each(n_chunks))
        best = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(search, found)
        return best.withColumn("place", place).filter(F.col("place") <= k)
    blocks, chunks = _along(rows, score.lead, key, n_blocks, "block"), _along(wanted, score.lead, key, n_chunks, "chunk")

    def spans(rows: DataFrame, name: str) -> DataFrame:
        open_end = F.count_if(F.col("lead").isNull() | F.isnan("lead")) > 0
        low = F.when(open_end, float("-inf")).otherwise(F.min("lead"))
        high = F.when(open_end, float("inf")).otherwise(F.max("lead"))
        return rows.groupBy(name).agg(low.alias("low"), high.alias("high"))

    # One row per block and per chunk: thousands of candidates to a row.
    of_blocks = spans(blocks, "block").agg(F.collect_list(F.struct("block", "low", "high")).alias("_blocks")).withColumn("_one", F.lit(1))
    middle = chunks.groupBy("chunk").agg(F.percentile_approx("lead", 0.5).alias("middle"))
    meetings = middle.withColumn("_one", F.lit(1)).join(of_blocks, "_one").select("chunk", "middle", F.explode("_blocks").alias("b"))
    meetings = stored(meetings.select("chunk", "middle", "b.block", "b.low", "b.high"), "meetings")
    away = F.greatest(F.col("low") - F.col("middle"), F.col("middle") - F.col("high"), F.lit(0.0))
    first = meetings.groupBy("chunk").agg(F.min_by("block", F.struct(F.coalesce(away, F.lit(0.0)), "block")).alias("block"))

    def met(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        left = asked.join(pairs, "chunk")
        right = blocks.join(pairs.select("block", "chunk"), "block")
        return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(search, found)

    ends = meetings.select("chunk", "block", "low", "high")
    near = stored(met(ends.join(first, ["chunk", "block"]), chunks.withColumn("least", F.lit(None).cast("double"))), "near")
    held = near.groupBy("target").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
    asked = stored(chunks.join(held.withColumnRenamed("target", key), key, "left"), "asked")
    # A chunk meets a block if one of its targets could find something better there.
    reach = F.pandas_udf(_reaches(score.bound, digits), T.BooleanType())
    others = asked.select("chunk", "lead", "least").join(ends.join(first, ["chunk", "block"], "left_anti"), "chunk")
    open_pairs = others.filter(reach("lead", "low", "high", "least")).select("chunk", "block", "low", "high").distinct()
    far = met(stored(open_pairs, "open"), asked)
    return near.unionByName(far).withColumn("place", place).filter(F.col("place") <= k)


def _may_reach(bound: Callable[[float, float, float], float], x: float, low: float, high: float, least: float, digits: int) -> bool:
    """Can a target with lead x and a k-th best score find one as good from low to high? Ties count, as keys decide them."""
    if not np.isfinite([x, low, high, least]).all():
        return True
    return bound(x, low, high) >= least - 10.0**-digits


def _reaches(bound: Callable[[float, float, float], float], digits: int):
    def reach(lead: pd.Series, low: pd.Series, high: pd.Series, least: pd.Series) -> pd.Series:
        values = zip(*(c.to_numpy(dtype="float64", na_value=np.nan) for c in (lead, low, high, least)), strict=True)
        return pd.Series([_may_reach(bound, *v, digits) for v in values])

    return reach


def _best_of_block(prepare: Callable, bound: Callable, k: int, key: str, digits: int):
    """The k best of a block for each target of a chunk that may find something there."""

    def run(targets: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(targets) and len(block):
            ids, score = block[key].to_numpy(), prepare(block)
            for t in targets.astype(object).where(targets.notna(), None).to_dict("records"):
                numbers = [np.nan if t[c] is None else float(t[c]) for c in ("lead", "low", "high", "least")]
                if not _may_reach(bound, *numbers, digits):
                    continue
                s = np.round(score(t), digits)
                s[ids == t[key]] = -np.inf
                # everything that ties with the k-th best stays in until the ids decide
                cut = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                close = np.flatnonzero((s >= cut) & (s > -np.inf))
                best = close[np.lexsort((ids[close], -s[close]))[:k]]
                found.append(pd.DataFrame({"target": t[key], "candidate": ids[best], "score": s[best]}))
        return pd.concat(found) if found else pd.DataFrame({"target": [], "candidate": [], "score": []}).astype({"target": block[key].dtype, "candidate": block[key].dtype})

    return run
