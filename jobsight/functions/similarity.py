"""Similarity of two runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of each dimension
DEFAULT_WEIGHTS = {
    "input_size": 0.3,
    "app_name": 0.2,
    "num_stages": 0.15,
    "executor_config": 0.15,
    "shuffle_size": 0.1,
    "output_size": 0.1,
}

# Columns of the run vector, in order; executor_cores is not log scaled
VECTOR_COLUMNS = [
    "input_bytes",
    "output_bytes",
    "shuffle_read_bytes",
    "shuffle_write_bytes",
    "total_stages",
    "total_tasks",
    "num_executors",
    "executor_cores",
    "executor_memory_mb",
    "duration_ms",
]


def magnitude_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger; two zeros are equal, one zero matches nothing."""
    return (
        F.when((a == 0) & (b == 0), F.lit(1.0))
        .when((a == 0) | (b == 0), F.lit(0.0))
        .otherwise(F.least(a, b).cast("double") / F.greatest(a, b).cast("double"))
    )


def bigrams(text: Column) -> Column:
    """Distinct character pairs of a text; empty when it is shorter than two."""
    return F.when(
        F.length(text) >= 2,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))),
    ).otherwise(F.array().cast("array<string>"))


def name_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    gx, gy = bigrams(x), bigrams(y)
    union = F.size(F.array_union(gx, gy))
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .when(F.contains(x, y) | F.contains(y, x), F.lit(0.8))
        .when(union == 0, F.lit(1.0))
        .otherwise(F.size(F.array_intersect(gx, gy)).cast("double") / union)
    )


def config_similarity(a: str, b: str) -> Column:
    parts = [
        magnitude_similarity(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
        for c in ("num_executors", "executor_cores", "executor_memory_mb")
    ]
    return (parts[0] + parts[1] + parts[2]) / 3


def weighted_similarity(a: str, b: str, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean over the dimensions present on both sides of the structs ``a`` and ``b``."""
    w = weights or DEFAULT_WEIGHTS

    def both(*cols: str) -> Column:
        present = F.lit(True)
        for c in cols:
            present = present & F.col(f"{a}.{c}").isNotNull() & F.col(f"{b}.{c}").isNotNull()
        return present

    def size(c: str) -> Column:
        return magnitude_similarity(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))

    dims = [
        ("input_size", both("input_bytes"), size("input_bytes")),
        ("app_name", both("app_name"), name_similarity(F.col(f"{a}.app_name"), F.col(f"{b}.app_name"))),
        ("num_stages", both("total_stages"), size("total_stages")),
        (
            "executor_config",
            both("num_executors", "executor_cores", "executor_memory_mb"),
            config_similarity(a, b),
        ),
        ("shuffle_size", both("shuffle_write_bytes"), size("shuffle_write_bytes")),
        ("output_size", both("output_bytes"), size("output_bytes")),
    ]
    score, total = F.lit(0.0), F.lit(0.0)
    for name, present, value in dims:
        score = score + F.when(present, value * F.lit(w[name])).otherwise(F.lit(0.0))
        total = total + F.when(present, F.lit(w[name])).otherwise(F.lit(0.0))
    return F.when(total > 0, score / total).otherwise(F.lit(0.0))


def importance(weights: dict[str, float] | dict[str, Column] | None = None) -> dict[str, float] | dict[str, Column]:
    """Shares of the weights in their sum, for numbers or columns; columns that are all zero have shares of zero."""
    w = weights or DEFAULT_WEIGHTS
    total = sum(w.values())
    if isinstance(total, Column):
        return {k: F.when(total > 0, v / total).otherwise(F.lit(0.0)) for k, v in w.items()}
    return {k: v / total for k, v in w.items()}


def run_vector() -> Column:
    """Ten log-scaled numbers describing a run."""
    return F.array(
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            if c == "executor_cores"
            else F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
            for c in VECTOR_COLUMNS
        ]
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(F.size(a) == 0, F.lit(float("inf"))).otherwise(
        F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    )
