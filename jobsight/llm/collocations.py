"""Phrases whose words belong together: counts of word runs by multikey quicksort of suffix pointers, and their scores.

A text is lower-cased in A-Z, cut into pieces at ``[.,;:!?]`` and line ends, and pieces into words at spaces and tabs. A
suffix pointer stands for a place in a piece and the words that follow it. Within a block of documents equal pointers are
one with a weight. Pointers are routed by a hash of their leading words, all of a phrase to one bucket of bounded size;
there a three-way quicksort goes through them word by word: what equals the pivot is one word of a phrase, its weight is the
phrase's count, and goes on with the next word. A part whose weight is below the least count is abandoned, whole.

1. Pointers of two words, routed by both, give words and pairs of words with their counts.
2. Pointers of three and four words go out only where all neighbours may be frequent pairs, by a bitmap of fixed size that
   has no false negative; routed by the first three words, they are sorted down to the last.
3. Scores, the cut of each phrase, and phrases inside longer ones are joins of these counts. Each language is ranked in
   two steps, so that no task gets all of its phrases.

Words are 64-bit hashes on the way; two different words with one hash end the job with an error rather than a wrong count.
Counts are exact; products of them are decimals. Null texts are empty, a null language is ``und``. Texts of any length are
read whole, a chunk at a time. Ties are ordered by the phrase in byte order. Repeated rows count each; extra columns do not
matter; a table without rows or without frequent phrases gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobsight.llm.batches import filled, packed, slices, small_batches, unpacked
from jobsight.llm.near_dup import mix
from jobsight.llm.ordering import shuffle_width
from jobsight.session import stored

DEPTH, LEAST, TOP = 4, 30, 2000
#: Words of one block of documents, bytes of text cut into words at once, bytes of text whose pointers share a bucket.
BLOCK_WORDS, CHUNK, BUCKET_BYTES = 2_000_000, 1 << 20, 8 << 20
#: Bits that say which pairs of words may be frequent; 8 MB, whatever the input.
CELLS = 1 << 26
#: Parts of a language ranked on their own first.
RANKED_PARTS = 64
#: A longer phrase takes a shorter one with it at this percentage of its count.
CONTAINED = 80
SCALE = 2_000_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_SAME = bytes(range(256)).lower().translate(bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" "))
_BREAK, _NOTHING = -1, -2


class Words(dict):
    """Numbers of the words of a block, in order of appearance; the empty string is nothing and a line end a break."""

    def __init__(self):
        super().__init__({b"": _NOTHING, b"\n": _BREAK})
        self.seen = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.seen)
        self.seen.append(word)
        return number

    def numbers(self, text: str) -> Iterator[np.ndarray]:
        """The words of a text and its breaks, a chunk at a time; a break ends it."""
        data, at = text.encode().translate(_SAME), 0
        while at < len(data):
            end = data.find(b" ", at + CHUNK)
            end = len(data) if end < 0 else end
            parts = data[at:end].replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.__getitem__, parts), np.int32, len(parts))
            yield found[found != _NOTHING]
            at = end
        yield np.array([_BREAK], np.int32)

    def hashes(self) -> np.ndarray:
        """A hash per word; zero stands for no word and is none of them."""
        return np.array([xxhash.xxh3_64_intdigest(w) or 1 for w in self.seen], np.uint64)


def cells(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bits of pairs of words, from 1."""
    own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    return (mix(mix(first ^ own) + second) % np.uint64(CELLS)).astype(np.int64) + 1


def multikey_counts(columns: list[np.ndarray], weights: np.ndarray, least: int, report: Callable[[int, int, int], None]) -> None:
    """Call ``report(length, pointer, count)`` for each run of leading words that ``least`` or more pointers share by weight;
    ``columns`` are the words of the pointers, 0 after their last."""
    parts = [(np.arange(len(weights)), 0)]
    while parts:
        pointers, depth = parts.pop()
        if int(weights[pointers].sum()) < least:
            continue
        words = columns[depth][pointers]
        pivot = words[len(words) // 2]
        same = words == pivot
        if not same.all():
            less = words < pivot
            parts.append((pointers[less], depth))
            parts.append((pointers[~(less | same)], depth))
            pointers = pointers[same]
        count = int(weights[pointers].sum())
        if pivot and count >= least:
            report(depth + 1, int(pointers[0]), count)
            if depth + 1 < len(columns):
                parts.append((pointers, depth + 1))


_ROUTED = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("pointers", T.BinaryType()),
        T.StructField("weights", T.BinaryType()),
    ]
)


def _batch(schema: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of the keys in it)"""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([bucket[:1] >= 0, bucket[order][1:] != bucket[order][:-1]])).tolist() + [len(bucket)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[order[a]]), order[a:b]


def _followed(stream: np.ndarray, depth: int) -> list[np.ndarray]:
    """Word numbers at every place of a stream and at the ``depth`` - 1 after it, ``_BREAK`` from the first break on."""
    padded = np.concatenate([stream, np.full(depth, _BREAK, np.int32)])
    columns = [stream]
    for k in range(1, depth):
        columns.append(np.where(columns[-1] >= 0, padded[k : k + len(stream)], _BREAK))
    return [c.astype(np.int64) for c in columns]


def _pairs(lang: str, words: Words, hashes: np.ndarray, stream: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of single words and of pointers of two words."""
    counts = np.bincount(stream[stream >= 0], minlength=len(hashes))
    present = np.flatnonzero(counts)
    for bucket, at in _dealt(hashes[present], buckets):
        own = present[at]
        yield bucket, lang, 1, [words.seen[i] for i in own], hashes[own].tobytes(), packed(counts[own].astype(np.uint32))
    first, second = _followed(stream, 2)
    both = (first >= 0) & (second >= 0)
    keys, weights = np.unique(first[both] * len(hashes) + second[both], return_counts=True)
    first, second = hashes[keys // max(len(hashes), 1)], hashes[keys % max(len(hashes), 1)]
    for bucket, at in _dealt(mix(mix(first) + second), buckets):
        yield bucket, lang, 2, None, np.concatenate([first[at], second[at]]).tobytes(), packed(weights[at].astype(np.uint32))


def _runs(lang: str, hashes: np.ndarray, stream: np.ndarray, buckets: int, may: np.ndarray) -> Iterator[tuple]:
    """Rows of pointers of three and four words whose neighbours all may be frequent pairs."""
    size = len(hashes)
    columns = _followed(stream, DEPTH)
    keep = columns[2] >= 0
    columns = [c[keep] for c in columns]
    pairs, place = np.unique(np.concatenate([columns[k] * size + columns[k + 1] for k in (0, 1)]), return_inverse=True)
    place = place.reshape(2, -1)
    good = _frequent(lang, hashes, pairs, may)
    keep = good[place[0]] & good[place[1]]
    columns, heads = [c[keep] for c in columns], place[0][keep]
    # The fourth word stays only where it may go on.
    tails = columns[2] * (size + 1) + columns[3] + 1
    ends, place = np.unique(tails, return_inverse=True)
    last = ends % (size + 1) - 1
    fits = last >= 0
    fits[fits] = _frequent(lang, hashes, (ends // (size + 1))[fits] * size + last[fits], may)
    fourth = np.where(fits, last, _BREAK)[place]
    ends, place = np.unique(columns[2] * (size + 1) + fourth + 1, return_inverse=True)
    keys, weights = np.unique(heads * np.int64(max(len(ends), 1)) + place, return_counts=True)
    head, tail = pairs[keys // max(len(ends), 1)], ends[keys % max(len(ends), 1)]
    padded = np.concatenate([hashes, np.zeros(1, np.uint64)])
    found = [hashes[head // max(size, 1)], hashes[head % max(size, 1)], hashes[tail // (size + 1)], padded[tail % (size + 1) - 1]]
    for bucket, at in _dealt(mix(mix(mix(found[0]) + found[1]) + found[2]), buckets):
        yield bucket, lang, DEPTH, None, np.concatenate([c[at] for c in found]).tobytes(), packed(weights[at].astype(np.uint32))


def _frequent(lang: str, hashes: np.ndarray, pairs: np.ndarray, may: np.ndarray) -> np.ndarray:
    size = max(len(hashes), 1)
    bit = cells(lang, hashes[pairs // size], hashes[pairs % size]) - 1
    return (may[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _routed(docs: DataFrame, buckets: int, may=None) -> DataFrame:
    """Pointers of all texts by bucket: of two words, or of three and four by the bitmap ``may`` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if may is None else np.frombuffer(may.value, np.uint8)
        words, streams, size = Words(), {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            hashes = words.hashes()
            for lang, parts in streams.items():
                stream = np.concatenate(parts)
                made = _pairs(lang, words, hashes, stream, buckets) if bits is None else _runs(lang, hashes, stream, buckets, bits)
                yield _batch(_ROUTED, list(made))

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), filled(part.column("text")).to_pylist(), strict=True):
                    for found in words.numbers(text):
                        streams.setdefault(lang, []).append(found)
                        size += len(found)
                    if size >= BLOCK_WORDS:
                        yield from rows()
                        words, streams, size = Words(), {}, 0
        yield from rows()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, "text").mapInArrow(run, _ROUTED)


#: Words of a phrase by their hashes, 0 after the last; ``word`` of single ones; length 0 is the number of all words.
_COUNTED = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("word", T.StringType()),
        T.StructField("cell", T.LongType()),
        T.StructField("f", T.LongType()),
    ]
)


def _singles(lang: str, rows: list[dict], least: int) -> list[tuple]:
    total, by_hash = {}, {}
    for row in rows:
        hashes = np.frombuffer(row["pointers"], np.int64).tolist()
        for word, h, count in zip(row["words"], hashes, unpacked(row["weights"], np.uint32).tolist(), strict=True):
            if by_hash.setdefault(h, word) != word:
                raise ValueError(f"two words of {lang!r} have the hash {h}: {word!r}, {by_hash[h]!r}")
            total[h] = total.get(h, 0) + count
    out = [(lang, 1, [h], by_hash[h].decode(), None, f) for h, f in total.items() if f >= least]
    return [*out, (lang, 0, None, None, None, sum(total.values()))]


def _sorted_out(lang: str, depth: int, rows: list[dict], least: int) -> list[tuple]:
    parts = [np.frombuffer(r["pointers"], np.uint64).reshape(depth, -1) for r in rows]
    columns = list(np.concatenate(parts, axis=1))
    weights = np.concatenate([unpacked(r["weights"], np.uint32) for r in rows]).astype(np.int64)
    found: dict[int, tuple[list, list]] = {n: ([], []) for n in range(1, depth + 1)}

    def report(length: int, pointer: int, count: int) -> None:
        found[length][0].append(pointer)
        found[length][1].append(count)

    multikey_counts(columns, weights, least, report)
    out = []
    # Shorter runs are not whole here: they were routed by more words than they have.
    for length in range(2 if depth == 2 else 3, depth + 1):
        pointers, counts = found[length]
        words = np.stack([columns[k][pointers] for k in range(length)], axis=1)
        bits = cells(lang, words[:, 0], words[:, 1]).tolist() if length == 2 else [None] * len(counts)
        out += [(lang, length, w, None, c, f) for w, c, f in zip(words.view(np.int64).tolist(), bits, counts, strict=True)]
    return out


def _counted(routed: DataFrame, least: int) -> DataFrame:
    """Phrases with ``least`` occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def counts() -> Iterator[pa.RecordBatch]:
            _, lang, depth = held
            out = _singles(lang, rows, least) if depth == 1 else _sorted_out(lang, depth, rows, least)
            for a in range(0, len(out), 8192):
                yield _batch(_COUNTED, out[a : a + 8192])

        for batch in batches:
            for row in (r for part in slices(batch, "pointers") for r in part.to_pylist()):
                key = row["bucket"], row["lang"], row["depth"]
                if key != held and rows:
                    yield from counts()
                    rows = []
                held = key
                rows.append(row)
        if rows:
            yield from counts()

    # Buckets are the unit of memory; each language and depth of one is sorted on its own.
    spread = routed.repartition(shuffle_width(routed), "bucket", "lang").sortWithinPartitions("bucket", "lang", "depth")
    return spread.mapInArrow(run, _COUNTED)


def _bitmap(pairs: DataFrame) -> bytes:
    """The bits of the frequent pairs; 4 KB a row of the result, ``CELLS`` / 8 bytes in all."""
    parts = pairs.groupBy(F.bitmap_bucket_number("cell").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = bytearray(CELLS // 8)
    for row in parts.toLocalIterator():
        out[(row["at"] - 1) * 4096 : row["at"] * 4096] = row["bits"]
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, length, words, word, cell, f) of all runs of up to four words that occur ``least`` times or more in a language,
    and with length 0 parts of its number of words; stored."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(shuffle_width(docs), -(-size // BUCKET_BYTES))
    with small_batches(spark):
        short = stored(_counted(_routed(docs, buckets), least), "phrases")
        may = spark.sparkContext.broadcast(_bitmap(short.filter("length = 2")))
        long = stored(_counted(_routed(docs, buckets, may), least), "phrases")
    return short.unionByName(long)


def _best_cuts(counts: DataFrame) -> DataFrame:
    """(lang, words, a, score, l, r) of every phrase by the cut that scores lowest, the first of those."""
    f = counts.filter("length > 0").select("lang", "words", "f")
    phrases = counts.filter("length > 1").select("lang", "words", F.col("f").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words"))})
    cuts = cuts.join(f.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return best.select("lang", "words", "a", "c.score", "c.l", "c.r")


def _inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, words, longest): the count of the most frequent longer phrase that holds a phrase."""
    longer = counts.filter("length > 2").select("lang", "words", "length", "f")
    sizes = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    starts = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("n") + 1)))
    return starts.groupBy("lang", F.slice("words", F.col("at"), F.col("n")).alias("words")).agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Per language its ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, least)
    kept = _best_cuts(counts).join(_inside_longer(counts), ["lang", "words"], "left")
    kept = kept.filter(F.col("longest").isNull() | (100 * F.col("longest") < CONTAINED * F.col("a"))).drop("longest")
    spelt = counts.filter("length = 1").select("lang", F.col("words")[0].alias("h"), "word")
    each = kept.select("lang", "words", F.posexplode("words").alias("at", "h")).join(spelt, ["lang", "h"])
    shown = each.groupBy("lang", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(shown, ["lang", "words"])
    order = "ORDER BY score DESC, a DESC, phrase"
    rows = rows.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(RANKED_PARTS)))
    rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})")).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).filter(F.col("rank") <= top)
    n = counts.filter("length = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return rows.join(n, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")
