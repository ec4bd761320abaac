"""Token ids in files of directly addressable codes.

An id is split into chunks of ``WIDTH`` bits, lowest first. Level 0 holds the first chunk of every id and a bitmap that
says which ids go on; level 1 holds the second chunk of those, with its own bitmap, and so on. A rank directory counts
the set bits before every block of ``RANK`` bits, so the place of an id's next chunk is one look-up and the bits of less
than one block: any token, or any run of tokens, is read without decoding what stands before it.

One file holds consecutive documents in ascending doc_id order, at most ``FILE_TOKENS`` ids unless a single document is
longer. Spark writes and reads the files as rows (bucket, seq, sizes, code), since executors share only what Spark
writes; the code is the file.

Null and empty texts hold the end id alone. Repeated doc_ids stay next to each other, ordered by text; null doc_ids come
first. Other columns do not matter; a table without rows gives no files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.batches import filled, held, map_batches, slices
from jobsight.llm.ordering import bucketed, order_key, shuffle_width
from jobsight.llm.pretokens import PartTable, byte_letters
from jobsight.session import shared_dir

VOCABULARY = "word_bpe_49k.json"
MAGIC = b"DACIDS01"
WIDTH, RANK, FILE_TOKENS = 8, 512, 1 << 20
_LATIN_WORD = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch


def pack(ids: np.ndarray) -> bytes:
    """The levels of some ids: per level its size, chunks, continuation bitmap and rank directory."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> WIDTH
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK // 8), np.uint8)])
        per_block = np.bitwise_count(bits).reshape(-1, RANK // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[np.uint64(0)], np.cumsum(per_block)]).astype("<u8")
        out.append(struct.pack("<QQ", len(rest), len(bits)) + (rest & (1 << WIDTH) - 1).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not goes_on.any():
            return struct.pack("<I", len(out)) + b"".join(out)
        rest = more[goes_on]


class Codes:
    """Reads levels made by ``pack``, from byte ``at`` of a file on."""

    def __init__(self, data, at: int = 0):
        self._levels = []
        (levels,) = struct.unpack_from("<I", data, at)
        at += 4
        for _ in range(levels):
            size, n_bits = struct.unpack_from("<QQ", data, at)
            at += 16
            chunks = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + size)
            ranks = np.frombuffer(data, "<u8", n_bits * 8 // RANK + 1, at + size + n_bits)
            at += size + n_bits + ranks.nbytes
            self._levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(level, place: int) -> int:
        """Set bits before ``place``."""
        _, bits, ranks = level
        block = place // RANK
        part = bits[block * RANK // 8 : place // 8]
        tail = int(bits[place // 8]) & (1 << place % 8) - 1 if place % 8 else 0
        return int(ranks[block]) + int(np.bitwise_count(part).sum()) + tail.bit_count()

    def __len__(self) -> int:
        return len(self._levels[0][0])

    def token(self, place: int) -> int:
        """The id at one place."""
        value = shift = 0
        for level in self._levels:
            value |= int(level[0][place]) << shift
            if not level[1][place // 8] >> place % 8 & 1:
                break
            place, shift = self._rank(level, place), shift + WIDTH
        return value

    def run(self, start: int, end: int) -> np.ndarray:
        """The ids from one place up to another."""
        value = np.zeros(end - start, np.uint32)
        who = np.arange(end - start)
        for depth, level in enumerate(self._levels):
            if start >= end:
                break
            value[who] |= level[0][start:end].astype(np.uint32) << (WIDTH * depth)
            first = start // 8
            goes_on = np.unpackbits(level[1][first : (end + 7) // 8], bitorder="little")[start - first * 8 : end - first * 8].astype(bool)
            who = who[goes_on]
            start = self._rank(level, start)
            end = start + len(who)
        return value


def write_file(doc_ids: list[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: which documents it holds, where each starts in it, and the codes."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = MAGIC + struct.pack("<Q", len(doc_ids)) + known.tobytes() + numbers.tobytes() + np.asarray(bounds, "<u8").tobytes()
    return head + pack(ids)


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """The documents of a file, the bounds of their ids, and the codes."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    (n,) = struct.unpack_from("<Q", data, 8)
    known = np.frombuffer(data, np.uint8, n, 16)
    numbers = np.frombuffer(data, "<i8", n, 16 + n)
    bounds = np.frombuffer(data, "<u8", n + 1, 16 + 9 * n).astype(np.int64)
    return [int(d) if k else None for d, k in zip(numbers, known, strict=True)], bounds, Codes(data, 16 + 9 * n + 8 * (n + 1))


class WordIds:
    """Ids of texts by a tokenizers file, a distinct part of the texts at a time."""

    def __init__(self, path: str, glued: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer, self._glued = Tokenizer.from_file(path), glued
        self._model, self._letters = self._tokenizer.model, dict(enumerate(byte_letters()))
        self._table = PartTable(self._many, glued)
        # Words of Latin-1 letters are one pre-token each, which the library's model takes directly; the file must agree.
        probe = [space + w for space in ("", " ") for w in ["the", "Words", *(c + c for c in map(chr, range(256)) if c.isalpha())]]
        self._direct = self._words(probe) == self._encoded(probe)

    def _words(self, parts: list[str]) -> list[list[int]]:
        """Ids of words of Latin-1 letters; all are turned into the letters of the file at once, with line ends between."""
        if not parts:
            return []
        text = "\n".join(parts if self._glued else [p.strip() for p in parts])
        shown = (text if self._glued else text.lower()).encode().decode("latin-1").translate(self._letters)
        tokenize = self._model.tokenize
        return [[t.id for t in tokenize(word)] for word in shown.split(self._letters[10])]

    def _encoded(self, parts: list[str]) -> list[list[int]]:
        if not parts:
            return []
        return [e.ids for e in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _many(self, parts: list[str]) -> list[list[int]]:
        if not self._direct:
            return self._encoded(parts)
        plain = [_LATIN_WORD(part) is not None for part in parts]
        words = iter(self._words(list(compress(parts, plain))))
        rest = iter(self._encoded([part for part, own in zip(parts, plain, strict=True) if not own]))
        return [next(words if own else rest) for own in plain]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._table.ids(texts)


def word_ids(path: str, glued: bool) -> WordIds:
    """One tokenizer per worker process. ``glued``: spaces belong to the part after them, as in byte-level files; else
    the tokenizer drops white space. Either way no token reaches over the place before a space."""
    with open(path, encoding="utf-8") as f:
        if json.load(f).get("truncation"):
            raise ValueError("a tokenizer that truncates can't be used part by part")
    return held(WordIds, path, glued)


FILE_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("code", T.BinaryType()),
    ]
)


def _bucket_files(rows: Iterator[tuple[int, int | None, np.ndarray]]) -> Iterator[tuple]:
    """Files of documents that come in order, bucket by bucket."""
    bucket, seq, before, docs, kept, size = None, 0, 0, [], [], 0

    def file():
        lengths = [len(k) for k in kept]
        return bucket, seq, before, len(docs), size, write_file(docs, np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(kept))

    for b, doc, ids in rows:
        if docs and (b != bucket or size + len(ids) > FILE_TOKENS):
            yield file()
            seq, before, docs, kept, size = seq + 1, before + size, [], [], 0
        if b != bucket:
            bucket, seq, before = b, 0, 0
        docs.append(doc)
        kept.append(ids)
        size += len(ids)
    if docs:
        yield file()


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write their files below ``path``."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    width = shuffle_width(docs)
    dealt = bucketed(docs.select("doc_id", "text"), 3 * width).repartition(width, "bucket")
    dealt = dealt.select("bucket", F.col("doc_id").cast("long").alias("doc_id"), "text").sortWithinPartitions("bucket", order_key(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = word_ids(vocabulary, False)

        def rows():
            for batch in batches:
                for part in slices(batch, "text"):
                    flat, bounds = tool.ids(filled(part.column("text")))
                    spots = zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False)
                    for b, doc, start, end in spots:
                        yield b, doc, np.append(flat[start:end], np.int32(end_id))

        for found in _bucket_files(rows()):
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(FILE_SCHEMA.names, found, strict=True)}, schema=_files_in_arrow())

    dealt.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def _files_in_arrow() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(FILE_SCHEMA)


def read(spark, path: str) -> DataFrame:
    """Every document of the files below ``path``: doc_id, the ids before it in all files, and its own ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _each_document(files, schema, lambda doc, start, ids: {"doc_id": doc, "start": start, "ids": ids.astype(np.int32)})


def digests(spark, path: str) -> DataFrame:
    """As ``read``, with the count and the checksum of the ids in their place."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return _each_document(files, schema, lambda doc, start, ids: {"doc_id": doc, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4"))})


def _each_document(files: DataFrame, schema: T.StructType, show) -> DataFrame:
    # One row per bucket, as many as the files were dealt into; the running total over them is bounded likewise.
    totals = files.groupBy("bucket").agg(F.sum("n_tokens").alias("tokens"))
    sizes = sorted((r.bucket, r.tokens) for r in totals.collect())
    base, at = {}, 0
    for bucket, tokens in sizes:
        base[bucket], at = at, at + tokens

    def make():
        def work(batch):
            out = {n: [] for n in schema.names}
            for bucket, before, code in zip(*(batch.column(n).to_pylist() for n in ("bucket", "before", "code")), strict=True):
                docs, bounds, codes = read_file(code)
                for doc, start, end in zip(docs, bounds, bounds[1:], strict=False):
                    row = show(doc, base[bucket] + before + int(start), codes.run(int(start), int(end)))
                    for n, v in row.items():
                        out[n].append(v)
            return out

        return work

    return map_batches(files.select("bucket", "before", "code"), make, schema, "code")


def stored_digests(docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    path = shared_dir(docs.sparkSession, "token-files")
    write(docs, path)
    return digests(docs.sparkSession, path)
