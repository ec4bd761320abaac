"""Queries: the sample workloads over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsight.functions.numeric import half_even, long_sum, mean_of
from jobsight.operators import workloads as wl
from jobsight.plans.diagnosis import r
from jobsight.plans.registry import query

SALES_SQL = {
    "sales": """
SELECT s.*, revenue, CASE WHEN revenue < 100 THEN 'Small' WHEN revenue < 500 THEN 'Medium' ELSE 'Large' END AS transaction_size
FROM (SELECT *, amount * quantity AS revenue FROM (
  SELECT l_orderkey AS order_key, l_linenumber AS line, o_custkey AS customer_id, c_mktsegment AS region,
    l_returnflag || l_linestatus AS category, CAST(ROUND(l_discount * 100) AS BIGINT) AS amount,
    CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) x) s""".replace(
        "SELECT s.*, revenue,", "SELECT s.*,"
    ),
    "skewed": """
SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS value1,
  CAST(ROUND(l_discount * 100) AS BIGINT) AS value2,
  CASE WHEN l_orderkey % 100 < 80 THEN 'A' WHEN l_orderkey % 100 < 90 THEN 'B' WHEN l_orderkey % 100 < 95 THEN 'C'
    WHEN l_orderkey % 100 < 98 THEN 'D' ELSE 'E' END AS skewed_key FROM lineitem""",
    "partners": """
SELECT CASE WHEN o_orderkey % 100 < 80 THEN 'A' ELSE 'OTHER' END AS skewed_key, o_orderkey FROM orders""",
}


def work(name: str, sql: str | None):
    return query(name, sql, SALES_SQL)


def sales(t):
    """Sales rows: discount percent plays the amount, so all three size classes occur."""
    o = t.raw("orders").select("o_orderkey", "o_custkey")
    c = t.raw("customer").select("c_custkey", "c_mktsegment")
    rows = (
        t.raw("lineitem")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("line"),
            F.col("o_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("region"),
            F.concat("l_returnflag", "l_linestatus").alias("category"),
            F.expr("CAST(ROUND(l_discount * 100) AS BIGINT)").alias("amount"),
            F.col("l_quantity").cast("long").alias("quantity"),
        )
    )
    return wl.with_revenue(rows)


def skewed(t):
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("long").alias("value1"),
        F.expr("CAST(ROUND(l_discount * 100) AS BIGINT)").alias("value2"),
        F.expr(
            "CASE WHEN l_orderkey % 100 < 80 THEN 'A' WHEN l_orderkey % 100 < 90 THEN 'B'"
            " WHEN l_orderkey % 100 < 95 THEN 'C' WHEN l_orderkey % 100 < 98 THEN 'D' ELSE 'E' END"
        ).alias("skewed_key"),
    )


def partners(t):
    return t.raw("orders").select(
        F.expr("CASE WHEN o_orderkey % 100 < 80 THEN 'A' ELSE 'OTHER' END").alias("skewed_key"), "o_orderkey"
    )


# the same characters as wl.WHITESPACE
_SPLIT = (
    "unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'))"
)


@work(
    "agg_24_word_count",
    f"SELECT word, COUNT(*) AS count FROM (SELECT {_SPLIT} AS word FROM documents) x WHERE word <> '' GROUP BY word",
)
def _(t):
    return wl.word_count(t.raw("documents"))


@work(
    "agg_24_distinct_words",
    f"SELECT COUNT(DISTINCT word) AS words FROM (SELECT {_SPLIT} AS word FROM documents) x WHERE word <> ''",
)
def _(t):
    return wl.words(t.raw("documents")).agg(F.count_distinct("word").alias("words"))


@work("prj_05_size_class", "SELECT order_key, CAST(line AS BIGINT) AS line, revenue, transaction_size FROM sales")
def _(t):
    return sales(t).select("order_key", F.col("line").cast("long"), "revenue", "transaction_size")


_REVENUE = f"""CAST(SUM(revenue) AS BIGINT) AS total_revenue, COUNT(*) AS transaction_count,
  {r('CAST(SUM(revenue) AS DOUBLE) / COUNT(*)')} AS avg_revenue, {r('CAST(SUM(amount) AS DOUBLE) / COUNT(*)')} AS avg_amount"""


@work("agg_25_revenue_by_region", f"SELECT region, {_REVENUE} FROM sales GROUP BY region")
def _(t):
    return wl.revenue_by(sales(t), "region")


@work("agg_26_revenue_by_category", f"SELECT category, {_REVENUE} FROM sales GROUP BY category")
def _(t):
    return wl.revenue_by(sales(t), "category")


@work(
    "agg_27_size_distribution",
    "SELECT transaction_size, COUNT(*) AS count, CAST(SUM(revenue) AS BIGINT) AS total_revenue FROM sales GROUP BY transaction_size",
)
def _(t):
    return wl.revenue_by(sales(t), "transaction_size").select(
        "transaction_size", F.col("transaction_count").alias("count"), "total_revenue"
    )


@work(
    "agg_28_totals",
    f"""SELECT COUNT(*) AS transactions, CAST(SUM(revenue) AS BIGINT) AS total_revenue,
      {r('CAST(SUM(revenue) AS DOUBLE) / COUNT(*)')} AS avg_revenue FROM sales""",
)
def _(t):
    return wl.totals(sales(t))


@work(
    "top_07_top_customers",
    """SELECT customer_id, CAST(SUM(revenue) AS BIGINT) AS total_spent, COUNT(*) AS num_transactions FROM sales
    GROUP BY customer_id ORDER BY total_spent DESC, customer_id LIMIT 10""",
)
def _(t):
    return wl.top_customers(sales(t), "customer_id")


@work(
    "agg_29_key_profile",
    f"SELECT skewed_key, COUNT(*) AS rows, {r('CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM skewed)')} AS share FROM skewed GROUP BY skewed_key",
)
def _(t):
    return wl.key_profile(skewed(t), "skewed_key").withColumn("share", half_even("share", 6))


@work(
    "agg_29_skew_report",
    f"""SELECT COUNT(*) AS keys, MAX(n) AS largest, {r('MAX(n) / CAST(SUM(n) AS DOUBLE)')} AS largest_share,
      {r('MAX(n) * COUNT(*) / CAST(SUM(n) AS DOUBLE)')} AS skew_factor
    FROM (SELECT COUNT(*) AS n FROM skewed GROUP BY skewed_key) x""",
)
def _(t):
    out = wl.skew_report(skewed(t), "skewed_key")
    return out.withColumns({c: half_even(c, 6) for c in ("largest_share", "skew_factor")})


@work(
    "agg_29_skewed_group",
    """SELECT skewed_key, COUNT(*) AS count, CAST(SUM(value1) AS BIGINT) AS sum_value1, CAST(SUM(value2) AS BIGINT) AS sum_value2
    FROM skewed GROUP BY skewed_key""",
)
def _(t):
    return skewed(t).groupBy("skewed_key").agg(
        F.count(F.lit(1)).alias("count"),
        long_sum("value1").alias("sum_value1"),
        long_sum("value2").alias("sum_value2"),
    )


@work(
    "join_13_salted_join",
    """SELECT order_key, CAST(line AS BIGINT) AS line, value1, n AS join_value FROM skewed
    JOIN (SELECT skewed_key, COUNT(*) AS n FROM partners GROUP BY skewed_key) p USING (skewed_key)""",
)
def _(t):
    """The hot key is spread over salts; its partner, summed up first, is copied to each."""
    summed = partners(t).groupBy("skewed_key").agg(F.count(F.lit(1)).alias("join_value"))
    joined = wl.salted_join(skewed(t), summed, "skewed_key", ["order_key", "line"])
    return joined.select("order_key", F.col("line").cast("long"), "value1", "join_value")


@work(
    "join_13_join_size",
    """SELECT skewed_key, a.n * b.n AS rows FROM (SELECT skewed_key, COUNT(*) AS n FROM skewed GROUP BY 1) a
    JOIN (SELECT skewed_key, COUNT(*) AS n FROM partners GROUP BY 1) b USING (skewed_key)""",
)
def _(t):
    return wl.join_size(skewed(t), partners(t), "skewed_key")


@work(
    "join_14_joined_aggregates",
    """SELECT a.k AS multiplier, a.n AS rows, b.s AS sum_0, b.m AS avg_1, c.hi AS max_2, c.lo AS min_3
    FROM (SELECT value1 AS k, COUNT(*) AS n FROM skewed GROUP BY 1) a
    JOIN (SELECT order_key % 100 AS k, CAST(SUM(value1) AS BIGINT) AS s,
      round_even(CAST(SUM(value2) AS DOUBLE) / COUNT(*) * 1e6, 0) / 1e6 AS m FROM skewed GROUP BY 1) b USING (k)
    JOIN (SELECT order_key % 50 AS k, MAX(value2) AS hi, MIN(value1) AS lo FROM skewed GROUP BY 1) c USING (k)""",
)
def _(t):
    rows = skewed(t)
    a = rows.groupBy(F.col("value1").alias("multiplier")).agg(F.count(F.lit(1)).alias("rows"))
    b = wl.by_modulo(rows, "order_key", 100, "multiplier", sum_0=long_sum("value1"), avg_1=half_even(mean_of("value2"), 6))
    c = wl.by_modulo(rows, "order_key", 50, "multiplier", max_2=F.max("value2"), min_3=F.min("value1"))
    return a.join(b, "multiplier").join(c, "multiplier")


@work(
    "join_15_large_equi_join",
    """SELECT o_orderpriority AS priority, COUNT(*) AS rows, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    joined = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("rows"), long_sum(F.col("l_quantity").cast("long")).alias("quantity")
    )


_WIDE = [
    "num_tasks", "failed_tasks", "input_bytes", "output_bytes", "shuffle_read_bytes", "shuffle_write_bytes",
    "memory_spilled_bytes", "disk_spilled_bytes", "run_ms", "cpu_ms", "gc_ms",
]


@work("agg_30_wide_sums", f"SELECT {', '.join(f'CAST(SUM({c}) AS BIGINT) AS sum_{c}' for c in _WIDE)} FROM task_events")
def _(t):
    return wl.wide_sums(t.tasks, _WIDE)


@work(
    "agg_30_by_range",
    """SELECT app_key // 1000 AS range, CAST(SUM(num_tasks) AS BIGINT) AS sum_num_tasks, CAST(SUM(run_ms) AS BIGINT) AS sum_run_ms,
      CAST(SUM(gc_ms) AS BIGINT) AS sum_gc_ms FROM task_events GROUP BY 1""",
)
def _(t):
    return wl.by_range(t.tasks, "app_key", 1000, ["num_tasks", "run_ms", "gc_ms"])


@work(
    "agg_31_by_modulo",
    """SELECT app_key % 100 AS "partition", COUNT(*) AS rows, CAST(SUM(run_ms) AS BIGINT) AS sum_run, MAX(gc_ms) AS max_gc,
      MIN(cpu_ms) AS min_cpu FROM task_events GROUP BY 1""",
)
def _(t):
    return wl.by_modulo(
        t.tasks, "app_key", 100, "partition",
        rows=F.count(F.lit(1)), sum_run=long_sum("run_ms"), max_gc=F.max("gc_ms"), min_cpu=F.min("cpu_ms"),
    )


@work(
    "agg_32_describe",
    f"""SELECT COUNT(run_ms) AS count, CAST(SUM(run_ms) AS DOUBLE) / COUNT(run_ms) AS mean, {r('stddev_samp(run_ms)', 4)} AS stddev,
      MIN(run_ms) AS min, MAX(run_ms) AS max FROM task_events""",
)
def _(t):
    return wl.describe(t.tasks, "run_ms").withColumn("stddev", half_even("stddev", 4))
