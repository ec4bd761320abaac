"""Exact top-k by inner product over a bit-sliced index.

Vectors are scaled and floored to integers. Rows are dealt into blocks; a block keeps, for every dimension, the bits of
its rows' values as packed bitmaps, one bitmap per bit (offset binary, so no sign bit). A query adds slices: every
signed digit of every query component contributes the shifted slices of that dimension to two pools, plus and minus,
which carry-save adders of bitmap operations reduce to one row of score slices. Only the upper ``bits`` bits of every
value are added; what they leave out is bounded. From the most significant score slice downward the best rows are
picked, and the rows that the left-out bits may lift over the boundary with them; those few are scored exactly.

A query's own row is no candidate. Ties go to the smaller id. Vectors that are null or hold null or non-finite
components take no part; a shorter vector counts as zero in the dimensions it lacks. Rows repeating an id are
candidates of their own; where they are queries, each has its own k best rows, ranked from 1, and no row of its id is
among them. Components must keep scores within 64 bits. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.session import stored

SCALE, K, EVERY = 1024, 10, 100
#: Rows of a block, queries that meet a block at once, and the bits of a value that are added.
BLOCK_ROWS, QUERY_ROWS, BITS = 16_384, 2_048, 9


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component in double arithmetic."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, sign) of the non-zero signed digits of a number, no two of them next to each other."""
    place = 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            yield place, sign
            value -= sign
        value >>= 1
        place += 1


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The sum of bitmaps by weight: full adders take three bitmaps of a weight to one of it and one of the next."""
    out, place = [], 0
    while place < len(columns):
        column = columns[place]
        if place + 1 == len(columns) and len(column) > 1:
            columns.append([])
        while len(column) >= 3:
            a, b, c = column.pop(), column.pop(), column.pop()
            either = a ^ b
            column.insert(0, either ^ c)
            columns[place + 1].append(a & b | either & c)
        if len(column) == 2:
            a, b = column
            column[:] = [a ^ b]
            columns[place + 1].append(a & b)
        out.append(column[0] if column else None)
        place += 1
    return out


class SlicedBlock:
    """The bit-sliced index of one block; rows in ascending id order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, bits: int = BITS):
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.least = values.min(axis=0) if n else np.zeros(dims, np.int64)
        raised = values - self.least
        width = max(1, int(raised.max(initial=0)).bit_length())
        self.drop = max(0, width - bits)
        self.kept = raised >> self.drop
        self.words = -(-n // 64)
        self.slices = []
        for d in range(dims):
            own = []
            for b in range(width - self.drop):
                packed = np.packbits((self.kept[:, d] >> b & 1).astype(np.uint8), bitorder="little")
                own.append(np.concatenate([packed, np.zeros(self.words * 8 - len(packed), np.uint8)]).view(np.uint64))
            self.slices.append(own)

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum(query * kept) - low, which is never negative, and low.

        Minus a slice is the complement of the slice minus one, so negative digits add complements and lower ``low``.
        """
        columns: list[list[np.ndarray]] = [[]]
        low = 0
        for q, own in zip(query.tolist(), self.slices, strict=True):
            for place, sign in digits(q):
                for b, bitmap in enumerate(own):
                    at = place + b
                    while len(columns) <= at:
                        columns.append([])
                    columns[at].append(bitmap if sign > 0 else ~bitmap)
                    if sign < 0:
                        low -= 1 << at
        zero = np.zeros(self.words, np.uint64)
        return [zero if s is None else s for s in add_slices(columns)], low

    def best(self, query: np.ndarray, k: int, own_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids and exact scores of the k best rows, and of no others."""
        slices, _ = self.score_slices(query)
        n = len(self.ids)
        alive = np.zeros(self.words * 64, np.uint8)
        alive[:n] = self.ids != own_id if own_id is not None else 1
        alive = np.packbits(alive, bitorder="little").view(np.uint64)
        # What the left-out bits can add to a row at most, and at least, in units of the kept bits.
        rest = (1 << self.drop) - 1
        most, least = int(query[query > 0].sum()) * rest, int(query[query < 0].sum()) * rest
        slack = -(-(most - least) >> self.drop) + 1 if self.drop else 0
        # The largest threshold that at least k rows reach, bit by bit from the top.
        sure, tied, threshold = np.zeros_like(alive), alive, 0
        for place in range(len(slices) - 1, -1, -1):
            ones = tied & slices[place]
            if int(np.bitwise_count(sure | ones).sum()) >= k:
                tied, threshold = ones, threshold | 1 << place
            else:
                sure, tied = sure | ones, tied & ~slices[place]
        near = self._at_least(slices, alive, max(0, threshold - slack)) if slack else sure | tied
        rows = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[:n])
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]

    @staticmethod
    def _at_least(slices: list[np.ndarray], alive: np.ndarray, threshold: int) -> np.ndarray:
        """Rows whose score is the threshold or more, by comparing slices from the top."""
        over, same = np.zeros_like(alive), alive
        for place in range(len(slices) - 1, -1, -1):
            if threshold >> place & 1:
                same = same & slices[place]
            else:
                over, same = over | same & slices[place], same & ~slices[place]
        return over | same


FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, bits: int = BITS
) -> DataFrame:
    """For every row whose vec_id is a multiple of ``every``, its k best rows among all others."""
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v")), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("query", F.monotonically_increasing_id())
    n, n_asked = rows.count(), asked.count()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-n_asked // query_rows))
    # Every chunk of queries meets every block: copies of a chunk go by block, copies of a block by chunk.
    base = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: np.empty(0, np.int64) for n in FOUND.names})
        dims = max(left["v"].map(len).max(), right["v"].map(len).max())
        right = right.sort_values("vec_id", ignore_index=True)
        block = SlicedBlock(right["vec_id"].to_numpy(), _matrix(right["v"], dims), bits)
        out = []
        for query, own, q in zip(left["query"].tolist(), left["vec_id"].tolist(), _matrix(left["v"], dims), strict=True):
            ids, scores = block.best(q, k, own)
            out.append(pd.DataFrame({"query": query, "query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(out, ignore_index=True)

    found = asked.groupBy("block", "chunk").cogroup(base.groupBy("block", "chunk")).applyInPandas(search, FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
