"""Shards by jump consistent hashing: a stable key and the number of shards decide, and nothing else.

No ring or table of shards is kept. With one more shard, a key either stays or moves into the new shard. The generator
is the 64-bit linear congruential one of the published algorithm, in two 32-bit halves so that nothing overflows;
everything is column expressions.

Integer keys seed the generator as they are, other keys by their xxhash64; a null key is seed 0. Null texts count as no
bytes. Rows of one key share a shard, however often the row repeats, and get slots of their own. An input column with
the name of an output column is replaced. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.ordering import shuffle_width

#: Fixed value: the multiplier of the generator.
MULTIPLIER = 2862933555777941757
_M = [MULTIPLIER >> 16 * i & 0xFFFF for i in range(4)]
_LOW, _HALF = 0xFFFF, 0xFFFFFFFF


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1, modulo 2^64, as halves; every product has under 49 bits, every sum under 52."""
    middle, top, upper = low * _M[1], low * _M[3], high * _M[1]
    lower = low * _M[0] + F.shiftleft(middle.bitwiseAND(_LOW), 16) + 1
    higher = (
        F.shiftright(lower, 32)
        + F.shiftright(middle, 16)
        + low * _M[2]
        + F.shiftleft(top.bitwiseAND(_LOW), 16)
        + high * _M[0]
        + F.shiftleft(upper.bitwiseAND(_LOW), 16)
    )
    return higher.bitwiseAND(_HALF), lower.bitwiseAND(_HALF)


def jump(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key among ``shards``.

    A jump always goes up, so ``shards`` steps are enough; a state past the last shard stays as it is.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        place = state["place"]
        target = F.floor((place + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moves = place < shards
        return F.struct(
            high.alias("high"),
            low.alias("low"),
            F.when(moves, place).otherwise(state["shard"]).alias("shard"),
            F.when(moves, target).otherwise(place).alias("place"),
        )

    seed = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(seed, 32).alias("high"),
        seed.bitwiseAND(_HALF).alias("low"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("place"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"].cast("int"))


def seed_of(df: DataFrame, key: str) -> Column:
    return F.col(key) if isinstance(df.schema[key].dataType, T.IntegralType) else F.xxhash64(key)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, checksum, shard, slot within the shard and the shard among one more."""
    cells = shuffle_width(docs)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.withColumns(
        {
            "size": F.octet_length(body).cast("long") + 1,
            "text_crc32": F.crc32(body),
            "law": F.lit("key"),
            "shard": jump(seed_of(docs, key), shards),
            "grown_shard": jump(seed_of(docs, key), shards + 1),
        }
    )
    # Slots: numbers within small cells of a shard, after the rows of the cells before. There are shards x shuffle
    # partitions cells, so neither a cell nor the table of their sizes lands in one task.
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64(key, text), F.lit(cells)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(key, "text_crc32")) - 1
    numbered = placed.withColumn("_within", within)
    return numbered.join(sizes, ["shard", "_cell"]).withColumn("slot", (F.col("_before") + F.col("_within")).cast("long")).drop("_cell", "_before", "_within")
