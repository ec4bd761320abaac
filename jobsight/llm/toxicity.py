"""Toxicity by the noisy channel: restore what was written, then score it.

A character language model (letters given the two before, smoothed) is counted over the distinct words of the training
rows; words of several rows are likely as a whole, by their share of rows. A word with digits, signs or separators in it,
with a letter twice in a row, or spelt out letter by letter becomes a lattice: signs and digits may be the letters they
look like, repeats may be single, separators may be nothing or end a word. The Viterbi path under the model has the
restored words; what the word says as it is counts beside them.

Features of a text are its restored words, their first four and five letters, and beginnings of four to seven letters that
two, or three and more, different words near each other have: insults built on one stem are each too rare to be learned.
A feature counts if the lower bound of its share of toxic documents is high; its support is the least of the documents and of the contexts (neighbouring words)
that it is seen in, so copies of one document do not make a feature. Evidence is combined as one minus the product of the
doubts.

Fitted on all labelled rows outside the held-out fold, and on whole texts. Null and empty texts, and all texts if nothing could be learned, have the score of a text without evidence.
Repeated rows are scored alike; extra columns do not matter; a table without rows gives none.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import log, log10, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.llm.batches import filled, filter_batches, fold_batches, held, map_batches
from jobsight.llm.language import fold
from jobsight.llm.pretokens import ragged, words_of
from jobsight.session import stored

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: A feature's least support, the width of its lower bound in deviations, and the least bound that counts.
SUPPORT, DEVIATIONS, LEAST = 6, 2.5, 0.5
PREFIXES = (4, 5)
#: Beginnings that different words may have in common, how many words are told apart, and within how many words of the text.
STEMS, LEVELS, WINDOW = (4, 5, 6, 7), (2, 3), 200
#: One in so many clean rows shows first which features are ordinary words.
FIRST_PART = 8
#: The least share of the fit rows that have a word which is likely as a whole, so that pieces of disguises, which large
#: tables hold several times by chance, are none, and their number is bounded.
KNOWN_SHARE = 1 / 2000
#: The longest word whose count is kept; longer ones are decoded by their letters.
KNOWN_LENGTH = 40
#: Words remembered by one worker at most, and their longest length; both only bound memory.
_MEMO, _MEMO_LENGTH = 100_000, 60

#: The letters that digits and signs stand for.
LOOKS_LIKE = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "bg",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
}
_SIGNS = "".join(LOOKS_LIKE)
_LETTERS = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_REPEATS = re.compile(r"(.)\1+")
#: Punctuation around a word that no reading of it keeps.
_AROUND = ".,;:?*&%#)[]{}<>-_/=~^`'\""
_ENDS = _AROUND + "".join(c for c in LOOKS_LIKE if not c.isdigit())
_SIGN_LETTERS = {letter for letters in LOOKS_LIKE.values() for letter in letters}
_RUN = re.compile(r"([^\W\d_]|[@$!|+(€])\1\1+")
#: At least three single characters with separators between.
_GAP = r"(?:[^\w@$!|+(€]|_)"
_ONE = r"(?:[^\W_]|[@$!|+(€])"
_SPELT = re.compile(rf"(?<![^\W_]){_ONE}(?:{_GAP}+{_ONE}(?![^\W_])){{2,}}")


class CharModel:
    """log P(letter | two letters before), from counts of three letters; ^ starts and $ ends a word. ``words``: the counts
    of words that are likely as a whole."""

    def __init__(self, counts: dict[str, int], words: dict[str, int] | None = None):
        self._three, self._two = Counter(counts), Counter()
        one: Counter = Counter()
        for t, n in counts.items():
            self._two[t[:2]] += n
            one[t[2]] += n
        total = sum(one.values())
        self._one = {c: n / total for c, n in one.items()}
        self._rare = 0.1 / (total + 1)
        self._known: dict[str, float] = {}
        #: What cores of words were restored to; tasks go on with those of their worker, known by the name of the model.
        self.restored: dict[str, list[str]] = {}
        self.name = uuid.uuid4().hex
        all_ = sum((words or {}).values())
        self.words = {w: log(n / all_) for w, n in (words or {}).items()}
        self.beginnings = {w[:n] for w in self.words for n in range(1, len(w) + 1)}

    def log_p(self, before: str, letter: str) -> float:
        three = before + letter
        found = self._known.get(three)
        if found is None:
            base = self._one.get(letter, self._rare)
            found = self._known[three] = log((self._three[three] + 2 * base) / (self._two[before] + 2))
        return found


def _restored(name: str) -> dict[str, list[str]]:
    """An empty memory for the model of this name."""
    return {}


def remembering(model: CharModel) -> CharModel:
    """``model`` with what earlier tasks of this worker restored under it."""
    model.restored = held(_restored, model.name)
    return model


def lattice(text: str, literal: bool = False) -> list[tuple[list[str], float | None, float | None]]:
    """For each character the letters that it may have been, the cost of its being nothing, and that of a word's end
    there; None if it cannot be. Separators in a row are one. ``literal``: only separators may be nothing."""
    out: list[tuple[list[str], float | None, float | None]] = []
    before = ""
    for c in text:
        if c.isalpha():
            out.append(([c], SKIP if c == before and not literal else None, None))
        elif c in LOOKS_LIKE:
            # A sign may also be mere punctuation; a digit that stands for a letter is written, not left out.
            digit = c.isdigit()
            out.append(([*LOOKS_LIKE[c]], SKIP if not literal and (not digit or c == before) else None, None if digit or literal else SKIP))
        elif out and not out[-1][0]:
            # The wider the gap, the likelier a word ends there.
            out[-1] = [], out[-1][1] + WIDER, 0.0
        else:
            out.append(([], 0.0, 0.0))
        before = c
    return out


def squeezed(text: str) -> str:
    """``text`` with runs of three or more of one letter or sign as two, which may still mean one or two."""
    return _RUN.sub(r"\1\1", text)


def restore(text: str, model: CharModel, literal: bool = False) -> tuple[list[str], float]:
    """The likeliest words on the lattice and their log likelihood, in time linear in the text.

    Viterbi. A state is a place between words (empty), the beginning of a known word, or a space and the last two letters
    of a word that the letters alone make likely.
    """
    # A path is its last letter and the path before, so steps cost the same however long the text is.
    best: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    beginnings, log_p = model.beginnings, model.log_p
    for letters, skip, end in lattice(squeezed(text), literal):
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            inside = state[:1] == " "
            for letter in letters:
                if inside:
                    to, step = f" {state[2]}{letter}", score + log_p(state[1:], letter)
                else:
                    to, step = state + letter, score
                    if to in beginnings and (to not in after or step > after[to][0]):
                        after[to] = step, (path, letter)
                    if state:
                        continue
                    to, step = f" ^{letter}", score + UNKNOWN + log_p("^^", letter)
                if to not in after or step > after[to][0]:
                    after[to] = step, (path, letter)
            if skip is not None:
                # Leaving a character out costs as much as a letter does on average, so short words are not favoured.
                step = score - skip
                if state not in after or step > after[state][0]:
                    after[state] = step, path
            if end is not None and state:
                step = score - end + ended(state, model)
                if "" not in after or step > after[""][0]:
                    after[""] = step, (path, " ")
        best = after
    state = max(best, key=lambda state: (best[state][0] + ended(state, model), state))
    score = best[state][0] + ended(state, model)
    letters, path = [], best[state][1]
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).split(), score


def ended(state: str, model: CharModel) -> float:
    """What it adds to end a word in this state."""
    if not state:
        return 0.0
    return model.log_p(state[1:], "$") if state[0] == " " else model.words.get(state, float("-inf"))


#: The cost of leaving out a repeat or a sign, that of joining over each further separator, and the log share of unknown words.
SKIP, WIDER, UNKNOWN = 0.7, 2.0, -5.0


def decoded(text: str, model: CharModel) -> list[str]:
    """The words that a disguise may be: the likeliest, and the likeliest that leave no sign out.

    A text of digits is a number unless words are likelier than its digits; a sign over and over spells nothing.
    """
    signs = {c for c in text if c in LOOKS_LIKE}
    if not any(map(str.isalpha, text)):
        if all(map(str.isdigit, signs)):
            words, score = restore(text, model)
            return words if score > -log(10) * sum(map(text.count, signs)) else []
        if len(signs) == 1:
            return []
    words = restore(text, model)[0]
    return words + [w for w in restore(text, model, True)[0] if w not in words] if signs else words


def core_of(word: str, outer: Callable[[str], bool]) -> str:
    """``word`` without the characters at its ends that are ``outer``."""
    start, end = 0, len(word)
    while start < end and outer(word[start]):
        start += 1
    while start < end and outer(word[end - 1]):
        end -= 1
    return word[start:end]


def readings(word: str, model: CharModel) -> list[str]:
    """The words that a run of characters without spaces may mean: as it is, and restored if it holds a repeat, a sign or
    a separator."""
    word = word.lower()
    if word.isalpha() and not _DOUBLE.search(word):
        return [word]
    found = _LETTERS.findall(word)
    # The signs at its ends may be punctuation: both readings are tried.
    whole = core_of(word, lambda c: not c.isalpha() and c not in LOOKS_LIKE)
    for core in {whole, core_of(whole, lambda c: not c.isalpha() and not c.isdigit())}:
        if core and (not core.isalpha() or _DOUBLE.search(core)):
            # The same core comes with many kinds of punctuation around it.
            words = model.restored.get(core)
            if words is None:
                words = decoded(core, model)
                if len(model.restored) < _MEMO and len(core) <= _MEMO_LENGTH:
                    model.restored[core] = words
            found += words
    return list(dict.fromkeys(found))


class Dull:
    """Whether no reading of a word begins like one of some features, where that is seen without decoding it.

    The word has only letters, apart from punctuation around it: its readings differ in repeats alone, so they are one
    without repeats. At least four different letters may be followed by up to three signs, which are letters at the end or
    words too short to be a feature.
    """

    def __init__(self, features: Iterable[str]):
        self.beginnings = {f[: PREFIXES[0]] for f in features}
        self._single = {_REPEATS.sub(r"\1", b) for b in self.beginnings}
        self._short = any(len(b) < PREFIXES[0] and set(b) <= _SIGN_LETTERS for b in self.beginnings)

    def __call__(self, word: str) -> bool:
        core = word.lower().strip(_AROUND)
        if core[: PREFIXES[0]] in self.beginnings:
            return False
        if core.isalpha():
            if not _DOUBLE.search(core):
                return True
            once = _REPEATS.sub(r"\1", core)
        else:
            letters = core.rstrip(_ENDS)
            if self._short or not letters.isalpha():
                return False
            once = _REPEATS.sub(r"\1", letters)
            if len(once) < PREFIXES[0] or sum(c in LOOKS_LIKE for c in squeezed(core[len(letters) :])) >= PREFIXES[0]:
                return False
        return not any(once[:n] in self._single for n in range(1, PREFIXES[0] + 1))


def spelt_out(text: str, model: CharModel) -> Iterator[tuple[str, int]]:
    """Words spelt letter by letter, restored, each with a hash of the words around it."""
    for m in _SPELT.finditer(text):
        # The words beside the run only tell contexts apart, so their nearest letters do.
        before, after = text[max(0, m.start() - 40) : m.start()].split()[-1:], text[m.end() : m.end() + 40].split()[:1]
        words = decoded(m.group().lower(), model)
        line = [*(before or [""]), *words, *(after or [""])]
        for i, word in enumerate(words):
            yield word, context(line[i], line[i + 2])


def context(before: str, after: str) -> int:
    return xxhash.xxh64_intdigest(f"{before} {after}") >> 1


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) >= n]


def gathered(places: dict[str, list[tuple[int, str]]], length: int) -> Iterator[tuple[str, int]]:
    """The stems that several different words near each other have, by levels, each with a hash of these words.

    ``places`` are the positions and words of each stem in a text of ``length`` words. In long texts words meet by chance
    more often, so one word less is counted for every tenfold of the window.
    """
    chance = max(0, round(log10(max(length, 1) / WINDOW)))
    for stem, found in places.items():
        if len(found) <= LEVELS[0] + chance - 1:
            continue
        near: Counter = Counter()
        most, start = frozenset(), 0
        for at, word in found:
            near[word] += 1
            while found[start][0] <= at - WINDOW:
                near[found[start][1]] -= 1
                near += Counter()
                start += 1
            if len(near) > len(most):
                most = frozenset(near)
        around = context(stem, " ".join(sorted(most)))
        for level in LEVELS:
            if len(most) - chance >= level:
                yield f"{stem}~{level}", around


def alike(a: str, b: str) -> bool:
    """Whether two features begin alike, so that one of them says what the other does."""
    a, b = a.partition("~")[0], b.partition("~")[0]
    return a.startswith(b) or b.startswith(a)


def trigrams(words: Iterable[str]) -> dict[str, int]:
    """Counts of three letters in a row, ^ before and $ after a word."""
    codes = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    first, second, third = codes[:-2], codes[1:-1], codes[2:]
    inside = (first != ord("$")) & (second != ord("$"))
    found, counts = np.unique(((first << 42) | (second << 21) | third)[inside], return_counts=True)
    letter = (1 << 21) - 1
    return {f"{chr(t >> 42)}{chr(t >> 21 & letter)}{chr(t & letter)}": n for t, n in zip(found.tolist(), counts.tolist(), strict=True)}


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """As np.unique, whose hashing is many times slower than sorting numbers that are almost in order."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def rows_with_parts(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct runs of letters in the texts, lower-cased, and in how many texts each is."""
    distinct, numbers, offsets = words_of(texts)
    own = [_LETTERS.findall(w.lower()) for w in distinct]
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    index: dict[str, int] = {}
    flat = np.fromiter((index.setdefault(x, len(index)) for found in own for x in found), np.int64, int(lengths.sum()))
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    rows, words = np.divmod(_distinct(rows * len(distinct) + numbers), max(1, len(distinct)))
    held_ = lengths[words]
    parts = flat[ragged((np.cumsum(lengths) - lengths)[words], held_)]
    pairs = _distinct(np.repeat(rows, held_) * len(index) + parts)
    return list(index), np.bincount(pairs % max(1, len(index)), minlength=len(index))


def _fit_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled rows outside the held-out fold, with their texts, written once."""
    wanted = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(FOLDS) != HELD_OUT))
    texts = docs.select("doc_id", "text").filter(fold(FOLDS) != HELD_OUT)
    # Merged whatever the size, so that shuffles grow with the texts from the start.
    return stored(texts.join(wanted.dropDuplicates(["doc_id"]).hint("merge"), "doc_id"), "fit-rows")


def _model(rows: DataFrame, count: int) -> CharModel:
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("word", T.BooleanType()), T.StructField("n", T.LongType())])

    def make():
        def work(batch):
            parts, rows_of = rows_with_parts(filled(batch.column("text")))
            counts = trigrams(parts)
            return {
                "part": [*counts, *parts],
                "word": [False] * len(counts) + [True] * len(parts),
                "n": [*counts.values(), *rows_of.tolist()],
            }

        return work

    counts = map_batches(rows, make, schema, "text").groupBy("word", "part").agg(F.sum("n").alias("n"))
    # Rare words and those too long to be one are left to the letters.
    least = max(SUPPORT, count * KNOWN_SHARE)
    counts = counts.filter(~F.col("word") | (F.col("n") >= least) & (F.length("part") <= KNOWN_LENGTH)).collect()
    return CharModel({r.part: r.n for r in counts if not r.word}, {r.part: r.n for r in counts if r.word})


def _word_features(word: str, model: CharModel, known: dict[str, list[str]]) -> list[str]:
    found = known.get(word)
    if found is None:
        found = [f for reading in readings(word, model) for f in features_of(reading)]
        if len(known) < _MEMO and len(word) <= _MEMO_LENGTH:
            known[word] = found
    return found


def _seen(text: str, model: CharModel, known: dict[str, list[str]]) -> Iterator[tuple[str, int]]:
    """The features of a text, each with a hash of the words around it."""
    words = text.split()
    places: dict[str, list[tuple[int, str]]] = {}
    for i, w in enumerate(words):
        around = context(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
        found = _word_features(w, model, known)
        for f in found:
            yield f, around
        for stem in stems_of(found[0]) if found else ():
            places.setdefault(stem, []).append((i, found[0]))
    yield from gathered(places, len(words))
    for reading, around in spelt_out(text, model):
        for f in features_of(reading):
            yield f, around


def stems_in(features) -> frozenset[str]:
    """The stems of features that several words have."""
    return frozenset(f.partition("~")[0] for f in features if f[-1:].isdigit() and "~" in f)


def lower_bound(good: int, all_: int, deviations: float = DEVIATIONS) -> float:
    """Wilson's lower bound of a share."""
    z2, p = deviations**2, good / all_
    return (p + z2 / (2 * all_) - deviations * sqrt(p * (1 - p) / all_ + z2 / (4 * all_**2))) / (1 + z2 / all_)


def _supported(rows: DataFrame, model: CharModel) -> dict[str, int]:
    """Features of toxic rows with enough support, and their support."""
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("around", T.LongType()), T.StructField("doc_id", T.LongType())])

    def make():
        remembering(model)
        known: dict[str, list[str]] = {}

        def work(batch):
            out = {"feature": [], "around": [], "doc_id": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), filled(batch.column("text")).to_pylist(), strict=True):
                for feature, around in set(_seen(text, model, known)):
                    out["feature"].append(feature)
                    out["around"].append(around)
                    out["doc_id"].append(doc)
            return out

        return work

    toxic = rows.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = map_batches(toxic, make, schema, "text").groupBy("feature")
    seen = seen.agg(F.least(F.approx_count_distinct("doc_id", 0.02), F.approx_count_distinct("around", 0.02)).alias("n")).filter(F.col("n") >= SUPPORT)
    # Bounded by the words of the toxic rows: each feature needs SUPPORT documents.
    return {r.feature: r.n for r in seen.collect()}


def undecided(supported: dict[str, int], clean: dict[str, int]) -> frozenset[str]:
    """The features that may count still, after some of the clean rows: with each more their bound only falls."""
    return frozenset(f for f, n in supported.items() if lower_bound(n, n + clean.get(f, 0)) >= LEAST)


def _clean_counts(rows: DataFrame, model: CharModel, supported: dict[str, int]) -> dict[str, int]:
    """In how many clean rows each supported feature is; for a feature that can't count, in so many that it can't.

    Most features are ordinary words. A part of the rows shows that, so that the others are only searched for the rest.
    """
    clean, counts = rows.filter("toxic = 0"), Counter()
    first = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_PART)) == 0
    for part in (first, ~first):
        if wanted := undecided(supported, counts):
            found = _rows_with(clean.filter(part).select("text"), model, wanted).groupBy("feature").agg(F.sum("n").alias("n"))
            counts.update({r.feature: r.n for r in found.collect()})
    return counts


def _rows_with(clean: DataFrame, model: CharModel, wanted: frozenset[str]) -> DataFrame:
    """In how many rows of each task each wanted feature is; a task counts all its rows before it gives anything out."""
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("n", T.LongType())])
    shared = stems_in(wanted)

    def make():
        remembering(model)
        dull = Dull((*wanted, *shared))
        counts: Counter = Counter()
        #: By word: its wanted features, the stems that it may share with others, and its first reading.
        known: dict[str, tuple[list[str], list[str], str]] = {}

        def told(word):
            if dull(word):
                out = [], [], ""
            else:
                own = _word_features(word, model, {})
                first = own[0] if own else ""
                out = [f for f in own if f in wanted], [stem for stem in stems_of(first) if stem in shared], first
            if len(known) < _MEMO and len(word) <= _MEMO_LENGTH:
                known[word] = out
            return out

        def work(batch):
            for text in filled(batch.column("text")).to_pylist():
                words, places, found = text.split(), {}, set()
                for i, w in enumerate(words):
                    own, stems, first = known.get(w) or told(w)
                    if own:
                        found.update(own)
                    for stem in stems:
                        places.setdefault(stem, []).append((i, first))
                found.update(f for f, _ in gathered(places, len(words)) if f in wanted)
                found.update(f for reading, _ in spelt_out(text, model) for f in features_of(reading) if f in wanted)
                counts.update(found)

        return work, lambda: {"feature": list(counts), "n": list(counts.values())}

    return fold_batches(clean, make, schema, "text")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[CharModel, dict[str, float], float]:
    """The character model, the weight (toxic share, lower bound) of every feature that counts, and the score of a text
    without evidence."""
    rows = _fit_rows(docs, labels)
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, all_ = counts.get(1, 0), sum(counts.values())
    model = _model(rows, all_)
    supported = _supported(rows, model)
    clean = _clean_counts(rows, model, supported)
    weights = {f: lower_bound(n, n + clean.get(f, 0)) for f, n in supported.items()}
    weights = telling_beginnings({f: w for f, w in weights.items() if w >= LEAST}, supported, clean)
    prior = (toxic + 1) / (all_ + 2)
    # With features at hand a text without any is much less likely toxic than the share of toxic rows.
    return model, weights, prior / 10 if weights else min(prior, THRESHOLD / 2)


def telling_beginnings(weights: dict[str, float], toxic: dict[str, int], clean: dict[str, int]) -> dict[str, float]:
    """``weights`` without the beginnings that tell something only through one word or longer beginning: where the rows
    without that one are clean, other words with the beginning are not evidence."""
    longer: dict[str, str] = {}
    for f in sorted(weights):
        for n in PREFIXES:
            short = f"{f[:n]}~"
            if "~" not in f[:n] and short in weights and short != f and weights[f] > weights.get(longer.get(short, ""), 0):
                longer[short] = f
    kept = dict(weights)
    for short, f in longer.items():
        bad, good = toxic[short] - toxic[f], clean.get(short, 0) - clean.get(f, 0)
        if good > 0 and (bad <= 0 or lower_bound(bad, bad + good) < LEAST):
            del kept[short]
    return kept


class Scorer:
    """Scores of texts by the features that count."""

    def __init__(self, model: CharModel, weights: dict[str, float], prior: float):
        self._model, self._weights, self._prior = model, weights, prior
        self._stems = stems_in(weights)
        self._dull = Dull((*weights, *self._stems))
        self._beginnings = self._dull.beginnings
        #: By word: its evidence, the stems that it may share with others, and its first reading.
        self._known: dict[str, tuple[tuple[str, ...], list[str], str]] = {}

    def _evidence(self, readings_: list[str]) -> tuple[str, ...]:
        """For each reading its strongest feature that counts; of features that begin alike, so that one word does not
        count twice, only the strongest."""
        found: list[str] = []
        for r in readings_:
            if r[: PREFIXES[0]] not in self._beginnings:
                continue
            own = [f for f in features_of(r) if f in self._weights]
            if own:
                found.append(max(own, key=lambda f: (self._weights[f], f)))
        if len(found) < 2:
            return tuple(found)
        return tuple(self._strongest(found))

    def _strongest(self, found) -> list[str]:
        """Of features that begin alike only the strongest."""
        kept: list[str] = []
        for f in sorted(found, key=lambda f: (-self._weights[f], f)):
            if not any(alike(f, g) for g in kept):
                kept.append(f)
        return kept

    def _told(self, word: str) -> tuple[tuple[str, ...], list[str], str]:
        found = readings(word, self._model)
        first = found[0] if found else ""
        stems = [x for x in stems_of(first) if x in self._stems] if first[: STEMS[0]] in self._beginnings else []
        return self._evidence(found), stems, first

    def scores(self, texts: pa.Array) -> list[float]:
        distinct, numbers, offsets = words_of(texts)
        known, fresh, telling = self._known, {}, np.zeros(len(distinct), bool)
        for i, word in enumerate(distinct):
            found = known.get(word)
            if found is None:
                if self._dull(word):
                    continue
                found = fresh[word] = self._told(word)
                if len(known) < _MEMO and len(word) <= _MEMO_LENGTH:
                    known[word] = found
            telling[i] = bool(found[0] or found[1])
        hits = np.flatnonzero(telling[numbers])
        owner = np.searchsorted(offsets, hits, "right") - 1
        evidence: dict[int, set[str]] = {}
        shared: dict[int, dict[str, list[tuple[int, str]]]] = {}
        for at, doc, n in zip(hits.tolist(), owner.tolist(), numbers[hits].tolist(), strict=True):
            own, stems, first = known.get(distinct[n]) or fresh[distinct[n]]
            if own:
                evidence.setdefault(doc, set()).update(own)
            for stem in stems:
                shared.setdefault(doc, {}).setdefault(stem, []).append((at, first))
        for doc, places in shared.items():
            more = [f for f, _ in gathered(places, int(offsets[doc + 1] - offsets[doc])) if f in self._weights]
            if more:
                evidence[doc] = set(self._strongest({*evidence.get(doc, ()), *more}))
        for doc, text in enumerate(texts.to_pylist()):
            for reading, _ in spelt_out(text, self._model):
                if found := self._evidence([reading]):
                    evidence.setdefault(doc, set()).update(found)
        out = [self._prior] * len(texts)
        for doc, features in evidence.items():
            doubt = 1 - self._prior
            for f in sorted(features):
                doubt *= 1 - self._weights[f]
            out[doc] = min(1.0, 1 - doubt)
        return out


def scored(docs: DataFrame, fitted: tuple[CharModel, dict[str, float], float]) -> DataFrame:
    """``docs`` with score and predicted."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("score", "predicted")] + added)
    model, weights, prior = fitted

    def make():
        tool = Scorer(remembering(model), weights, prior)

        def work(batch):
            scores = tool.scores(filled(batch.column("text")))
            return {n: batch.column(n) for n in schema.names[:-2]} | {"score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

        return work

    return map_batches(docs, make, schema, "text")


def clean(docs: DataFrame, fitted: tuple[CharModel, dict[str, float], float]) -> DataFrame:
    """The rows of ``docs`` that are not called toxic, with all their columns."""
    model, weights, prior = fitted

    def make():
        tool = Scorer(remembering(model), weights, prior)
        return lambda texts: [s < THRESHOLD for s in tool.scores(texts)]

    return filter_batches(docs, make)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score and predicted, learned from labelled rows of the other folds."""
    held_out = (fold(FOLDS) == HELD_OUT).alias("held_out")
    return scored(docs.select("doc_id", held_out, "text"), fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
