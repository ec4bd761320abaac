"""The sample workloads: word count, sales ETL, skew, wide aggregates and joins, each in its cheap form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even, long_sum, mean_of
from jobsight.operators.shapes import size_class

# The characters a word ends at
WHITESPACE = (
    "[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
)


def words(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.select(F.explode(F.split(column, WHITESPACE)).alias("word")).filter(F.col("word") != "")


def word_count(texts: DataFrame, column: str = "text") -> DataFrame:
    return words(texts, column).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def with_revenue(sales: DataFrame) -> DataFrame:
    """Revenue and its size class; amounts are whole cents, so sums are exact."""
    revenue = F.col("amount") * F.col("quantity")
    return sales.withColumn("revenue", revenue).withColumn("transaction_size", size_class(revenue))


def revenue_by(sales: DataFrame, key: str) -> DataFrame:
    return (
        sales.groupBy(key)
        .agg(
            long_sum("revenue").alias("total_revenue"),
            F.count(F.lit(1)).alias("transaction_count"),
            half_even(mean_of("revenue"), 6).alias("avg_revenue"),
            half_even(mean_of("amount"), 6).alias("avg_amount"),
        )
        .orderBy(F.desc("total_revenue"), key)
    )


def totals(sales: DataFrame) -> DataFrame:
    return sales.agg(
        F.count(F.lit(1)).alias("transactions"),
        long_sum("revenue").alias("total_revenue"),
        half_even(mean_of("revenue"), 6).alias("avg_revenue"),
    )


def top_customers(sales: DataFrame, key: str, k: int = 10) -> DataFrame:
    spent = sales.groupBy(key).agg(
        long_sum("revenue").alias("total_spent"), F.count(F.lit(1)).alias("num_transactions")
    )
    return spent.orderBy(F.desc("total_spent"), key).limit(k)


# Skew ------------------------------------------------------------------------


def key_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows and share of every key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    shares = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return shares.select(key, "rows", (F.col("rows") / F.col("_total")).alias("share"))


def skew_report(df: DataFrame, key: str) -> DataFrame:
    """How far the largest key is above the mean key."""
    profile = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return profile.agg(
        F.count(F.lit(1)).alias("keys"),
        F.max("rows").alias("largest"),
        (F.max("rows") / F.sum("rows")).alias("largest_share"),
        (F.max("rows") * F.count(F.lit(1)) / F.sum("rows")).alias("skew_factor"),
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner equi-join with a hot key on the left: left rows spread over ``salts`` parts, right rows copied to each."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    return left.withColumn("_salt", salt).join(right.select("*", copies), [key, "_salt"]).drop("_salt")


def join_size(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows an inner join would give, per key, from the counts of either side; no pair is formed."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    return a.join(b, key).select(key, (F.col("_l") * F.col("_r")).alias("rows"))


# Wide and modular aggregates -----------------------------------------------------


def wide_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All sums in one pass."""
    return df.agg(*[long_sum(c).alias(f"sum_{c}") for c in columns])


def by_range(df: DataFrame, value: str, width: int, sums: Sequence[str]) -> DataFrame:
    return df.groupBy(F.floor(F.col(value) / width).cast("long").alias("range")).agg(
        *[long_sum(c).alias(f"sum_{c}") for c in sums]
    )


def by_modulo(df: DataFrame, key: str, divisor: int, name: str, **aggregates: Column) -> DataFrame:
    return df.groupBy((F.col(key) % divisor).alias(name)).agg(*[v.alias(k) for k, v in aggregates.items()])


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, minimum and maximum of one column as one row."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"),
        mean_of(c).alias("mean"),
        F.stddev_samp(c).alias("stddev"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
