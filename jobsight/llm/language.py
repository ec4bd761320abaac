"""Language identification by cross-parsing: how few phrases of known text does a text take?

For every language a suffix automaton is built over a bounded sample of its labelled texts. A text is parsed greedily
into longest matches, each of which is a phrase of the sample; a letter that the sample does not have is a phrase of its
own. A phrase costs the bits that point into the sample, so a language's measure is phrases x log2(sample length) per
letter, and the language with the least wins. Phrases end with words: a word is parsed with the space before it, and
once however often it occurs.

The sample is the documented bound: ``DOCUMENTS`` different texts a language, the least by their hash, of each an excerpt
of ``LETTERS`` characters from a hashed place, so neither copies nor shared openings fill it. Texts without a letter
give none. Texts to be judged are parsed whole.

Null texts and texts without a letter are ``und`` with score 0. With no labelled text at all, everything is. Ties go to
the language that comes first in alphabetical order. Repeated rows are judged alike; extra columns do not matter; a
table without rows gives none.
"""

from __future__ import annotations

import re
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.batches import filled, filter_batches, held, map_batches
from jobsight.llm.pretokens import words_of

DOCUMENTS, LETTERS = 150, 300
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_MEMO = 100_000
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, by folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


class SuffixAutomaton:
    """All substrings of a text; ``steps[state]`` leads on by a character."""

    def __init__(self, text: str):
        steps, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new, at = len(steps), last
            steps.append({})
            link.append(0)
            length.append(length[last] + 1)
            while at >= 0 and c not in steps[at]:
                steps[at][c] = new
                at = link[at]
            if at >= 0:
                goal = steps[at][c]
                if length[at] + 1 == length[goal]:
                    link[new] = goal
                else:
                    twin = len(steps)
                    steps.append(dict(steps[goal]))
                    link.append(link[goal])
                    length.append(length[at] + 1)
                    while at >= 0 and steps[at].get(c) == goal:
                        steps[at][c] = twin
                        at = link[at]
                    link[goal] = link[new] = twin
            last = new
        self.steps = steps

    def phrases(self, text: str) -> int:
        """How many longest matches a greedy parse of ``text`` takes."""
        steps, here, n = self.steps, self.steps[0], 0
        start = here
        for c in text:
            state = here.get(c)
            if state is None:
                # The match ends before c, if one was under way; c starts the next, or is unknown.
                n += here is not start
                state = start.get(c)
                if state is None:
                    n, here = n + 1, start
                    continue
            here = steps[state]
        return n + (here is not start)


def normalised(text: str) -> str:
    """Lower-case letters, with one space for everything between."""
    return " " + _NOT_LETTERS.sub(" ", text.lower()).strip()


class Judge:
    """Measures of texts for every language of a sample."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in samples]
        self._parsers = [SuffixAutomaton(s) for _, s in samples]
        self._bits = np.array([log2(len(s) + 2) for _, s in samples])
        self._known: dict[str, int] = {}
        self._rows = np.zeros((1024, len(samples) + 1), np.float32)

    def _measure(self, word: str) -> list[int]:
        """Phrases by language, and letters."""
        parts = [" " + p for p in normalised(word).split()]
        return [sum(map(a.phrases, parts)) for a in self._parsers] + [sum(len(p) - 1 for p in parts)]

    def judge(self, texts) -> tuple[list[str], list[float]]:
        distinct, numbers, offsets = words_of(texts)
        known, fresh, places = self._known, {}, np.empty(len(distinct), np.int64)
        kept = len(known)
        for i, word in enumerate(distinct):
            at = known.get(word)
            if at is None:
                at = kept + len(fresh)
                fresh[word] = at
                if at == len(self._rows):
                    self._rows = np.resize(self._rows, (2 * at, self._rows.shape[1]))
                self._rows[at] = self._measure(word)
            places[i] = at
        total = np.zeros((len(offsets) - 1, self._rows.shape[1]))
        for column in range(total.shape[1]):
            ends = np.concatenate([[0], np.cumsum(self._rows[places, column].astype(np.float64)[numbers])])
            total[:, column] = np.diff(ends[offsets])
        # Either all new words are remembered or none, so places stay dense and memory bounded.
        if kept + len(fresh) <= _MEMO and sum(map(len, fresh)) <= 64 * _MEMO:
            known.update(fresh)
        letters = total[:, -1]
        cost = total[:, :-1] * self._bits / np.maximum(letters, 1)[:, None]
        names, scores = [], []
        for n, row in zip(letters, cost, strict=True):
            if not n or not len(row):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(row.argmin())
            rest = np.delete(row, best)
            names.append(self.languages[best])
            scores.append(float(1 - row[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
        return names, scores


def judge_of(samples: tuple[tuple[str, str], ...]) -> Judge:
    """One judge per worker process and sample."""
    return held(Judge, samples)


def samples_of(labelled: DataFrame, documents: int = DOCUMENTS, letters: int = LETTERS) -> tuple[tuple[str, str], ...]:
    """The bounded sample text of every language: rows (doc_id, text, lang)."""
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    plain = rows.select("lang", F.xxhash64("text").alias("h"), F.trim(F.regexp_replace("text", r"[^\p{L}]+", " ")).alias("text"))
    # Hashed again, as those of the least hash would all be cut at like places.
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - letters + 1, F.lit(1))).cast("int") + 1
    rows = plain.select("lang", "h", F.substring("text", start, F.lit(letters)).alias("text")).distinct()
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= documents)
    by_lang: dict[str, list[str]] = {}
    for row in sorted(rows.collect(), key=lambda r: (r.lang, r.n)):
        by_lang.setdefault(row.lang, []).append(normalised(row.text))
    return tuple((lang, "".join(texts)) for lang, texts in sorted(by_lang.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """``docs`` with lang_pred and score."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("lang_pred", "score")] + added)

    def make():
        tool = judge_of(samples)

        def work(batch):
            names, scores = tool.judge(filled(batch.column("text")))
            return {n: batch.column(n) for n in schema.names[:-2]} | {"lang_pred": names, "score": scores}

        return work

    return map_batches(docs, make, schema, "text")


def identified(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """The rows of ``docs`` that are in a language of the samples, with all their columns."""

    def make():
        tool = judge_of(samples)
        return lambda texts: [name != UNKNOWN for name in tool.judge(texts)[0]]

    return filter_batches(docs, make)


def learned(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    return samples_of(docs.filter(fold(FOLDS) != HELD_OUT).select("doc_id", "text", "lang"))


def predictions(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred and score, learned from the other folds."""
    held_out = (fold(FOLDS) == HELD_OUT).alias("held_out")
    return identify(docs.select("doc_id", held_out, "text"), learned(docs)).select("doc_id", "held_out", "lang_pred", "score")
