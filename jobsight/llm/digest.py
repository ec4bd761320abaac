"""Document fingerprints from improbable features.

Every window of ``WINDOW`` bytes has an entropy, and over all documents some entropies are rarer than others. Windows are
ranked by that rarity, rarest first; where the rarest window of ``SPAN`` neighbouring ones stays the same for at least
``POPULAR`` shifts, it is a feature. Features go, in order of appearance, into a chain of Bloom filters of 256 bytes that
take ``PER_FILTER`` features each. Two fingerprints are alike as far as the filters of the one with fewer overlap with
their best counterparts, beyond what chance gives and up to what their bits allow.

A text too short for a span has all its windows as features, one shorter than a window is one feature, and an empty or
null one has an empty fingerprint, which is like another empty one (1) and like nothing else (0). Equal texts have equal
fingerprints. The next document is the one of the next doc_id, null ids first; rows that repeat an id are ordered by
text; after the last comes the first, so a single row is its own next. Extra columns do not matter; a table without rows
gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobsight.llm.batches import filled, map_batches
from jobsight.llm.ordering import bucketed, order_key, shuffle_width

WINDOW, SPAN, POPULAR = 16, 16, 4
FILTER_BYTES, PER_FILTER, HASHES = 256, 160, 5
#: Entropies are told apart in so many steps.
BINS = 1024
#: Bytes of text worked on at once.
BLOCK_BYTES = 1 << 20

_SCALE = 1 << 16
_WEIGHT = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_MOST = int(_WEIGHT[WINDOW])


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """The entropy bin of the window at every place of some bytes.

    A window's entropy follows from the one before by the counts of the byte that leaves and the byte that comes, and
    those counts from comparing the bytes with themselves shifted by less than a window.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    after, before = np.zeros(len(data), np.int8), np.zeros(len(data), np.int8)
    for lag in range(1, WINDOW):
        same = data[lag:] == data[:-lag]
        after[:-lag] += same
        before[lag:] += same
    weight = np.empty(n, np.int64)
    weight[0] = _WEIGHT[np.bincount(data[:WINDOW])].sum()
    leaving, coming = after[: n - 1].astype(np.int64) + 1, before[WINDOW:].astype(np.int64)
    weight[1:] = _WEIGHT[leaving - 1] - _WEIGHT[leaving] + _WEIGHT[coming + 1] - _WEIGHT[coming]
    return (_MOST - np.cumsum(weight)) * (BINS - 1) // _MOST


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _blocks(texts: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BLOCK_BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


class Digester:
    """Fingerprints of texts, given the rank of every entropy bin."""

    def __init__(self, ranks: np.ndarray):
        self._ranks = ranks.astype(np.int64)

    def fingerprints(self, texts: list[bytes]) -> list[np.ndarray]:
        """The filters of each text, one row of bytes each."""
        return [f for block in _blocks(texts) for f in self._block(texts[block])]

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        # Texts shorter than a window are filled up, so that they have one.
        texts = [t.ljust(WINDOW, b"\0") if t else t for t in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        windows = np.maximum(lengths - WINDOW + 1, 0)
        if not windows.sum():
            return [np.empty((0, FILTER_BYTES), np.uint8) for _ in texts]
        bins = entropy_bins(data)
        bits = max(1, len(bins).bit_length())
        best = self._ranks[bins] << bits | np.arange(len(bins))
        reach = 1
        while reach < SPAN:
            step = min(reach, SPAN - reach)
            best = np.minimum(best[:-step], best[step:]) if len(best) > step else best[:0]
            reach += step
        spans = np.maximum(windows - SPAN + 1, 0)
        from jobsight.llm.pretokens import ragged

        chosen = best[ragged(starts, spans)] & (1 << bits) - 1
        votes = np.bincount(chosen, minlength=len(bins))
        picked = votes >= POPULAR
        # A text of few windows gives them all; one without a lasting choice gives the rarest of its first span.
        few = spans == 0
        picked[ragged(starts[few], windows[few])] = True
        totals = np.concatenate([[0], np.cumsum(picked)])
        none = (windows > 0) & (totals[starts + windows * (windows > 0)] - totals[np.minimum(starts, len(bins))] == 0)
        picked[best[starts[none]] & (1 << bits) - 1] = True
        places = np.flatnonzero(picked)
        owner = np.searchsorted(starts + lengths, places, "right")
        eight = data[places[:, None] + np.arange(WINDOW)].view(np.uint64)
        feature = np.zeros(len(places), np.uint64)
        for k in range(WINDOW // 8):
            feature = _mix(feature * np.uint64(0x9E3779B97F4A7C15) + eight[:, k] + np.uint64(k + 1))
        # Each feature once per text, in order of its first place.
        order = np.lexsort((places, feature, owner))
        first = np.ones(len(order), bool)
        first[1:] = (owner[order][1:] != owner[order][:-1]) | (feature[order][1:] != feature[order][:-1])
        kept = np.sort(order[first])
        owner, feature = owner[kept], feature[kept]
        per_text = np.bincount(owner, minlength=len(texts))
        number = np.arange(len(owner)) - (np.cumsum(per_text) - per_text)[owner]
        filters = -(-per_text // PER_FILTER)
        ends = np.cumsum(filters)
        where = ((ends - filters)[owner] + number // PER_FILTER) * FILTER_BYTES * 8
        flags = np.zeros(int(ends[-1]) * FILTER_BYTES * 8, np.uint8)
        for k in range(HASHES):
            flags[where + (feature >> np.uint64(11 * k) & np.uint64(FILTER_BYTES * 8 - 1)).astype(np.int64)] = 1
        rows = np.packbits(flags).reshape(-1, FILTER_BYTES)
        return [rows[e - f : e] for e, f in zip(ends, filters, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """How far the filters of the shorter chain overlap with their best counterparts, 0 to 1."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    size = FILTER_BYTES * 8
    bits_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = weight = 0.0
    for row in a:
        own = int(np.bitwise_count(row).sum())
        shared = np.bitwise_count(b & row).sum(axis=1, dtype=np.int64)
        # What the best of so many unrelated filters shares by chance does not count.
        mean, most = own * bits_b / size, np.minimum(own, bits_b)
        chance = mean + np.sqrt(mean * (1 - bits_b / size) * 2 * np.log(1 + len(b)))
        total += own * float(np.where(shared >= most, 1.0, np.clip((shared - chance) / np.maximum(most - chance, 1), 0, 1)).max())
        weight += own
    return total / weight


def shown(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BYTES)


def rarity_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of every entropy bin, rarest first, by its count over all windows of all documents."""
    schema = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])

    def make():
        def work(batch):
            counts = np.zeros(BINS, np.int64)
            texts = [t.encode() for t in filled(batch.column("text")).to_pylist()]
            for block in _blocks(texts):
                data = np.frombuffer(b"".join(texts[block]), np.uint8)
                lengths = np.array([len(t) for t in texts[block]], np.int64)
                inside = np.zeros(len(data) + 1, np.int64)
                whole = lengths >= WINDOW
                begins = (np.cumsum(lengths) - lengths)[whole]
                inside[begins] += 1
                inside[begins + lengths[whole] - WINDOW + 1] -= 1
                bins = entropy_bins(data)
                counts += np.bincount(bins[np.cumsum(inside)[: len(bins)] > 0], minlength=BINS)
            full = np.flatnonzero(counts)
            return {"bin": full, "n": counts[full]}

        return work

    rows = map_batches(docs.select("text"), make, schema, "text").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for row in rows:
        counts[row["bin"]] = row["n"]
    ranks = np.empty(BINS, np.int64)
    ranks[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    return ranks


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``fingerprint``."""
    ranks = rarity_ranks(docs)
    schema = T.StructType([f for f in docs.schema.fields if f.name != "fingerprint"] + [T.StructField("fingerprint", T.StringType())])

    def make():
        tool = Digester(ranks)

        def work(batch):
            texts = [t.encode() for t in filled(batch.column("text")).to_pylist()]
            return {n: batch.column(n) for n in schema.names[:-1]} | {"fingerprint": list(map(shown, tool.fingerprints(texts)))}

        return work

    return map_batches(docs, make, schema, "text")


COMPARED = [
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
]


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many of the start of the next."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text) in ascending order of doc_id within each bucket, a bucket in one partition.

    The first row of every bucket also ends the bucket before it, as an extra row.
    """
    width = shuffle_width(docs)
    rows = bucketed(docs.select("doc_id", "text"), 3 * width).withColumn("extra", F.lit(0))
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(order_key().alias("k"), "text", "doc_id")).alias("f"))
    # As many numbers as buckets, whatever the rows.
    used = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
    if not used:
        return rows.select("bucket", "extra", "doc_id", "text")
    before = F.create_map(*[F.lit(x) for pair in zip(used, [used[-1], *used[:-1]], strict=True) for x in pair])
    extra = firsts.select(before[F.col("bucket")].alias("bucket"), F.lit(1).alias("extra"), "f.doc_id", "f.text")
    rows = rows.select("bucket", "extra", "doc_id", "text").unionByName(extra)
    return rows.repartition(width, "bucket").sortWithinPartitions("bucket", "extra", order_key(), "text")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document."""
    ranks = rarity_ranks(docs)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *COMPARED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, arrow, waiting = Digester(ranks), to_arrow_schema(schema), []

        def out(rows):
            """Rows for all but the last of some consecutive rows."""
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
            texts = [r[3] for r in rows]
            changed = [edited(a[3], b[3]).encode() for a, b in pairs]
            prints = tool.fingerprints([t.encode() for t in texts] + changed)
            own = prints[: len(rows)]
            found = []
            at = 0
            for i, (a, _) in enumerate(zip(rows, rows[1:], strict=False)):
                if a[1]:
                    continue
                new = prints[len(rows) + at]
                found.append((a[2], len(a[3]), hashlib.sha256(changed[at]).hexdigest(), shown(own[i]), shown(new), likeness(own[i], new), likeness(own[i], own[i + 1])))
                at += 1
            columns = list(zip(*found, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        size = 0
        for batch in batches:
            columns = zip(*(batch.column(n).to_pylist() for n in ("bucket", "extra", "doc_id")), batch.column("text"), strict=True)
            for bucket, extra, doc, text in columns:
                waiting.append((bucket, extra, doc, text.as_py() or ""))
                size += len(waiting[-1][3])
                if size > BLOCK_BYTES and len(waiting) > 1:
                    yield out(waiting)
                    waiting = waiting[-1:]
                    size = len(waiting[0][3])
        if len(waiting) > 1:
            yield out(waiting)

    return with_next(docs).mapInArrow(run, schema)
