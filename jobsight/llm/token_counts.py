"""How many tokens each text has, mostly without merging anything.

Offline, once per vocabulary, every entry is run through the merges: those that end as one token are proven whole. A
pre-token that is a proven entry counts as one token at once; only the rest is merged. A special string inside a text
is one token, as the library has it by default.

Null and empty texts have no tokens. Texts are counted whole, whatever their length. Repeated rows are counted alike;
a table without rows gives none; other columns do not matter.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from jobsight.llm.batches import filled, held, map_batches
from jobsight.llm.pretokens import PartTable, byte_letters, splitter

VOCABULARY = "byte_bpe_50k.json"


class Counter:
    """Token counts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        self._model = Tokenizer.from_file(path).model
        special = [t["content"] for t in parsed["added_tokens"] if t["special"]]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self._starts = tuple(special)
        self._letters = dict(enumerate(byte_letters()))
        self._split = splitter(public_tokenizers.PATTERN)
        self.whole = self.proven(parsed["model"]["vocab"])
        self._table = PartTable(self._many)

    def proven(self, vocab: dict[str, int]) -> frozenset[str]:
        """The texts of those entries that the merges turn into themselves alone (only those that are valid UTF-8 can
        be a pre-token)."""
        byte_of = {letter: b for b, letter in self._letters.items()}
        found = []
        for entry, number in vocab.items():
            if [t.id for t in self._model.tokenize(entry)] == [number]:
                raw = bytes(byte_of[c] for c in entry)
                try:
                    found.append(raw.decode())
                except UnicodeDecodeError:
                    pass
        return frozenset(found)

    def _merge(self, pre: str) -> int:
        return len(self._model.tokenize(pre.encode().decode("latin-1").translate(self._letters)))

    def _tokens(self, text: str) -> int:
        pres = self._split(text)
        rest = [p for p in pres if p not in self.whole]
        return len(pres) - len(rest) + sum(map(self._merge, rest))

    def _many(self, parts: list[str]) -> list[range]:
        """What stands for each part is as long as it has tokens."""
        out = []
        for part in parts:
            plain = self._special.split(part) if any(s in part for s in self._starts) else [part]
            out.append(range(len(plain) - 1 + sum(map(self._tokens, plain))))
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        return self._table.counts(texts)


def counter(path: str) -> Counter:
    """One counter per worker process."""
    return held(Counter, path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether there are more than ``limit``."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def make():
        tool = counter(path)
        return lambda batch: {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": tool.count(filled(batch.column("text")))}

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return map_batches(sized, make, schema, "text").withColumn("over_limit", F.col("n_tokens") > limit)
