"""Tables dealt out in ascending order of an id without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Null ids come first in the order.
LEAST = -(1 << 63)


def order_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST))


def shuffle_width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, buckets: int, doc_id: str = "doc_id") -> DataFrame:
    """``df`` with ``bucket``: ascending ranges of the id with about as many rows each.

    The bounds are approximate quantiles of the id column alone; the driver gets ``buckets`` numbers, whatever the
    number of rows. All rows of one id are in one bucket.
    """
    shares = [i / buckets for i in range(1, buckets)]
    bounds = df.select(order_key(doc_id).alias("k")).agg(F.percentile_approx("k", shares, 10 * buckets)).first()[0] if shares else None
    cuts = sorted(set(bounds or []))
    above = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda n, c: n + (order_key(doc_id) > c).cast("int")) if cuts else F.lit(0)
    return df.withColumn("bucket", above)
