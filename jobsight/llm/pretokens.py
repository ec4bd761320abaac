"""Texts as numbers of their parts, so that work is done once per distinct part.

The pattern of byte-level vocabularies never lets a pre-token cross the place before a single space that stands between
two characters that are no white space. A text without a space followed by more white space can therefore be cut
before every space, and what a part becomes depends on nothing around it. Any other text is one part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# Any white space in Unicode's or in Python's sense.
_SPACE_THEN_SPACE = re.compile(r" \s")

#: Parts remembered by one worker at most, and their longest length; both only bound memory.
MEMO_ENTRIES, MEMO_LENGTH = 250_000, 48

#: What a word is often followed by. A letter before it always ends a pre-token, so it is handled as a part of its own.
#: No apostrophe, which begins the ends of English words, and nothing that added tokens of vocabularies have.
_TAIL = ".,!?:;$%&*#"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The pre-tokens of a text: every match of ``pattern``."""
    return regex.compile(pattern).findall


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files: a byte that prints in Latin-1
    stands for itself, the others follow from U+0100 in order."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return [chr(b) if prints[b] else chr(256 + sum(not p for p in prints[:b])) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0] + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PartTable:
    """Parts and the ids each stands for, found by ``make(parts)`` for many new parts at a time.

    It keeps the parts met first, which are the frequent ones, up to its bound; those beyond it are found again in the
    next slice.
    """

    def __init__(self, make: Callable[[list[str]], Sequence[Sequence[int]]], glued: bool = True):
        """``glued``: a space belongs to the part after it, as byte-level patterns have it."""
        self._make, self._glued = make, glued
        self._number: dict[str, int] = {}
        self._flat, self._starts, self._lengths = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self._kept = self._used = 0

    def _append(self, flat: np.ndarray, lengths: np.ndarray) -> range:
        """Add entries given their ids one after the other; their numbers."""
        n, at, end = len(flat), self._kept, self._kept + len(lengths)
        if self._used + n > len(self._flat):
            self._flat = np.resize(self._flat, max(2 * len(self._flat), self._used + n))
        if end > len(self._starts):
            room = max(2 * len(self._starts), end)
            self._starts, self._lengths = np.resize(self._starts, room), np.resize(self._lengths, room)
        self._flat[self._used : self._used + n] = flat
        self._lengths[at:end] = lengths
        self._starts[at:end] = self._used + np.cumsum(lengths) - lengths
        self._used, self._kept = self._used + n, end
        return range(at, end)

    def _find(self, parts: list[str]) -> tuple[list[int], dict[str, int]]:
        """The number of each part, and those that are new."""
        known = self._number
        missing = [p for p in parts if p not in known]
        if not missing:
            return [known[p] for p in parts], {}
        # A part with a tail is its core and its tail. Latin-1 letters stay letters under any normalisation.
        cut, needed = {}, {}
        for p in missing:
            core = p.rstrip(_TAIL)
            if core == p or not core or core[-1] >= "\u0100" or not core[-1].isalpha():
                needed[p] = None
                continue
            tail = p[len(core) :]
            cut[p] = core, tail
            if core not in known:
                needed[core] = None
            if tail not in known:
                needed[tail] = None
        made = self._make(list(needed))
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int32, int(lengths.sum()))
        fresh = dict(zip(needed, self._append(flat, lengths), strict=True))
        if cut:
            pairs = np.array([fresh[x] if x in fresh else known[x] for pair in cut.values() for x in pair], np.int64)
            lengths = self._lengths[pairs]
            flat = self._flat[ragged(self._starts[pairs], lengths)]
            fresh.update(zip(cut, self._append(flat, lengths.reshape(-1, 2).sum(axis=1)), strict=True))
        return [fresh[p] if p in fresh else known[p] for p in parts], fresh

    def _forget(self, fresh: dict[str, int], kept: int, used: int) -> None:
        """Keep what is new while there is room, else go back to how it was before."""
        if len(self._number) + len(fresh) <= MEMO_ENTRIES:
            self._number.update((p, k) for p, k in fresh.items() if len(p) <= MEMO_LENGTH)
        else:
            self._kept, self._used = kept, used

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, "Callable[[], None]"]:
        """The number of every part of the texts, where each text's parts end, and what to call when done with them."""
        plain = texts.to_pylist()
        heads: dict[int, str] = {}
        if self._glued:
            heads = {i: t for i, t in enumerate(plain) if _SPACE_THEN_SPACE.search(t)}
            if heads:
                texts = pa.array(["" if i in heads else t for i, t in enumerate(plain)])
        else:
            # White space that is dropped is the same wherever a part ends.
            texts = pc.replace_substring(texts, "\n", " ")
        pieces = pc.split_pattern(texts.cast(pa.large_string()), " ")
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        kept, used = self._kept, self._used
        if not self._glued:
            found, fresh = self._find(distinct)
            numbers = np.asarray(found, np.int64)[coded.indices.to_numpy()]
        else:
            first = [heads.get(i, t.partition(" ")[0]) for i, t in enumerate(plain)]
            found, fresh = self._find([" " + d for d in distinct] + list(dict.fromkeys(first)))
            numbers = np.asarray(found, np.int64)[coded.indices.to_numpy()]
            place = dict(zip(dict.fromkeys(first), found[len(distinct) :], strict=True))
            numbers[offsets[:-1]] = [place[f] for f in first]
        return numbers, offsets, lambda: self._forget(fresh, kept, used)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's ids start and end."""
        numbers, offsets, done = self.numbers(texts)
        lengths = self._lengths[numbers]
        flat = self._flat[ragged(self._starts[numbers], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        done()
        return flat, ends[offsets]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        numbers, offsets, done = self.numbers(texts)
        ends = np.concatenate([[0], np.cumsum(self._lengths[numbers])])
        done()
        return np.diff(ends[offsets])


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of the texts, cut at spaces and line ends; the number of every word; where each text's words end."""
    plain = pc.replace_substring_regex(texts.cast(pa.large_string()), r"[\t\n\r]", " ")
    pieces = pc.split_pattern(plain, " ")
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]
