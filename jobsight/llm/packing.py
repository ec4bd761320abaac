"""Best-fit packing of documents into sequences, with certified counts.

Documents longer than a sequence are cut, the shorter piece first. Pieces are dealt into groups of bounded size; each
group is packed best-fit decreasing, and dual-feasible functions give a lower bound of its count. A group that meets its
bound is certified optimal. The others have a gap: the pieces of their unfilled sequences are exchanged, that
is, dealt out anew among fewer groups, and packed again, round by round, until no gap is left or a round saves nothing.
Lengths are at most the capacity, so a group is worked on in memory that depends on its bounded row count only.

Null and empty texts are pieces of one id, the end id. Repeated rows and null doc_ids are pieces of their own. Extra
columns do not matter; a table without rows gives none.
"""

from __future__ import annotations

import zlib


import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.batches import filled, map_batches
from jobsight.llm.direct_codes import word_ids
from jobsight.session import stored

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_ID = 2048, 0
#: Pieces packed together by one task at most, about, and the rounds of exchange.
GROUP_PIECES, ROUNDS = 50_000, 4
#: A sequence of a certified group is exchanged if more than this share, 1 / EXCHANGED_FREE, is free.
EXCHANGED_FREE = 8


def cut(length: int, capacity: int) -> list[int]:
    """Where pieces of a document start: only the first may be shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [0, *range(first, length, capacity)]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encoded documents, each with the end id, cut into pieces no longer than the capacity."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def make():
        tool = word_ids(vocabulary, True)

        def work(batch):
            flat, bounds = tool.ids(filled(batch.column("text")))
            out = {n: [] for n in schema.names}
            for doc, begin, end in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                ids = np.append(flat[begin:end], np.int32(END_ID)).astype("<u4")
                starts = cut(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b]))
                    if with_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
            return out

        return work

    return map_batches(docs.select("doc_id", "text"), make, schema, "text")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in descending order: the bin and the offset of each, and how full each bin is.

    The fullest bin that still has room is taken, by a bitmap of the free spaces that some bin has.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that two families of dual-feasible functions give: no packing has fewer bins.

    The first drops lengths under a threshold and rounds those over capacity minus threshold up to the capacity; the
    second rounds multiples of capacity / (k + 1) to whole shares.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of how many lengths there are of each size."""
    sizes = np.arange(capacity + 1)
    mass, number = np.cumsum(counts * sizes), np.cumsum(counts)
    t = np.arange(0, capacity // 2 + 1)
    below = np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    large = number[-1] - number[capacity - t]
    best = int((large * capacity + mass[capacity - t] - below).max())
    for k in range(1, 51):
        scaled = (k + 1) * sizes
        shares = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * shares).sum()) // k))
    return -(-best // capacity)


PLACED = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("group", T.LongType()),
        T.StructField("bin", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("free", T.LongType()),
        T.StructField("gap", T.LongType()),
    ]
)


def _packed(todo: DataFrame, groups: int, round_no: int, capacity: int) -> DataFrame:
    """Pieces (uid, length) dealt into groups; each group packed and bounded."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return pd.DataFrame(
            {
                "uid": frame["uid"],
                "length": lengths,
                "group": frame["group"],
                "bin": bins,
                "offset": offsets,
                "free": capacity - fill[bins],
                "gap": len(fill) - lower_bound(lengths, capacity),
            }
        )

    dealt = todo.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(pack, PLACED)


def _bins(df: DataFrame) -> int:
    return df.filter("offset = 0").count()


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``."""
    table = stored(cut_pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    todo, finished = table.select("uid", "length"), []
    for round_no in range(rounds):
        rows = todo.count()
        if not rows:
            break
        groups = -(-rows // group_pieces)
        placed = stored(_packed(todo, groups, round_no, capacity), "packed")
        # What may still be packed better: the unfilled sequences of groups that miss their bound, and of certified
        # groups those with much room, as a certificate holds within its group only.
        exchanged = (F.col("free") > 0) & ((F.col("gap") > 0) | (F.col("free") * EXCHANGED_FREE > capacity)) & F.lit(groups > 1)
        open_ = placed.filter(exchanged)
        before, after = (_bins(todo), _bins(placed)) if round_no else (0, 0)
        if round_no and after >= before:
            break
        finished = [*finished, (round_no, placed.filter(~exchanged))]
        todo = open_
    if "bin" in todo.columns:
        # What no exchange improved stays as it was packed last.
        finished = [*finished, (max((r for r, _ in finished), default=0), todo)]
    done = None
    for round_no, part in finished:
        # 2^32 sequences a group, 2^24 groups a round.
        number = F.shiftleft(F.lit(round_no).cast("long"), 56) + F.shiftleft(F.col("group"), 32) + F.col("bin")
        part = part.select("uid", number.alias("sequence_id"), "offset")
        done = part if done is None else done.unionByName(part)
    if done is None:
        done = todo.select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return table.drop("sequence_id", "offset").join(done, "uid").drop("uid")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces with their place in sequences."""
    return pack(pieces(docs, vocabulary, capacity), capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences a packed table has, and how many any packing of its pieces needs.

    The driver gets one number per length, so at most as many as the capacity.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    return packed.filter("offset = 0").count(), bound_of_counts(counts, capacity)
