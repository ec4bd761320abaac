"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from the vocabulary.

Every vocabulary entry becomes one piece: its bytes, each shown as a printable character, scored by the negative rank,
so the merge of highest score is the merge of lowest rank. The normalisation is the identity and no white space is
added or escaped. Pre-tokens are encoded one by one; a pre-token that is an entry itself is that entry, as rank-based
encoders have it. Decoding maps ids back to the entries' bytes.

Null and empty texts have no ids. Texts of any length are encoded whole. Repeated rows are encoded alike, each for
itself; other columns pass through untouched, but an output column replaces an input column of the same name. A table
without rows gives none.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobsight.llm.batches import filled, held, list_of, map_batches
from jobsight.llm.pretokens import PartTable, byte_letters, splitter

VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in order of rank."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, f)}
    return [ranked[r] for r in range(len(ranked))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _message(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def serialise(entries: list[bytes], letters: list[str]) -> bytes:
    """A sentencepiece model file (protocol buffer) whose ids are the ranks, and one unknown piece after them."""
    unknown = len(entries)
    out = bytearray()
    for rank, entry in enumerate(entries):
        piece = "".join(letters[b] for b in entry).encode()
        out += _message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, 2))
    # Trainer part: model type 2 is BPE; the unknown id, and no begin, end and padding ids.
    out += _message(2, _number(3, 2) + _number(4, unknown + 1) + _number(40, unknown) + _number(41, -1) + _number(42, -1) + _number(43, -1))
    # Normaliser part: identity; no dummy prefix, white space neither removed nor escaped.
    out += _message(3, _message(1, b"identity") + _message(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.entries = read_ranks(path)
        letters = byte_letters()
        self._shown = {b: letters[b] for b in range(256)}
        self._whole = {entry: rank for rank, entry in enumerate(self.entries)}
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.entries, letters))
        self._split = splitter(pattern)
        self._table = PartTable(self._many)
        self._bytes = pa.array(self.entries, pa.large_binary())

    def _merge(self, pres: list[str]) -> dict[str, list[int]]:
        """The ids of pre-tokens; one call of the model for all, as a call costs more than a merge."""
        out, rest, shown = {}, [], []
        for pre in pres:
            raw = pre.encode()
            whole = self._whole.get(raw)
            if whole is not None:
                out[pre] = [whole]
            else:
                rest.append(pre)
                shown.append(raw.decode("latin-1").translate(self._shown))
        return out | dict(zip(rest, self._pieces.encode(shown, num_threads=1) if shown else (), strict=True))

    def _many(self, parts: list[str]) -> list[list[int]]:
        split = list(map(self._split, parts))
        merged = self._merge(list({pre for pres in split for pre in pres}))
        return [[i for pre in pres for i in merged[pre]] for pres in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the bounds of each text's."""
        return self._table.ids(texts)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each text's ids."""
        return pc.binary_join(list_of(bounds, self._bytes.take(pa.array(ids))), pa.scalar(b"", pa.large_binary()))


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return held(Codec, path, pattern)


def _with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + list(fields))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with the column ``ids``."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = _with(docs, T.StructField("ids", T.ArrayType(T.IntegerType())))

    def make():
        tool = codec(path, pattern)

        def work(batch):
            ids, bounds = tool.encode(filled(batch.column(text)))
            return {n: batch.column(n) for n in schema.names[:-1]} | {"ids": list_of(bounds, pa.array(ids)).cast(pa.list_(pa.int32()))}

        return work

    return map_batches(docs, make, schema, text)


def decode(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded``, the bytes of its ids; null ids as none."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = _with(df, T.StructField("decoded", T.BinaryType()))

    def make():
        tool = codec(path, pattern)

        def work(batch):
            lists = pc.fill_null(batch.column(ids), [])
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            return {n: batch.column(n) for n in schema.names[:-1]} | {"decoded": tool.decode(lists.flatten().to_numpy(), bounds).cast(pa.binary())}

        return work

    return map_batches(df, make, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document: how many ids, and digests of the ids and of the bytes decoded from them; ids stay inside the task."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def make():
        tool = codec(path, pattern)
        shown = pa.array([str(i) for i in range(len(tool.entries))], pa.large_string())

        def work(batch):
            ids, bounds = tool.encode(filled(batch.column("text")))
            listed = pc.binary_join(list_of(bounds, shown.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": np.diff(bounds),
                "ids_sha256": [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in listed.cast(pa.large_binary())],
                "decoded_sha256": [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in tool.decode(ids, bounds)],
            }

        return work

    return map_batches(docs.select("doc_id", "text"), make, schema, "text")
