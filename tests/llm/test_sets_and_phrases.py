"""Collocations, the prefix-tree join and the filter audit against brute force; edge cases of every column."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from jobsight.llm import collocations, components, filter_audit, prefix_trie

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, words STRING, home BIGINT, row BIGINT, f STRING"


def table(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "w", 7, 1, "f") for i, t, lang in rows], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ngrams(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked_by_force(rows, width, percent):
    sets, forest = [ngrams(t, width) for _, t, *_ in rows], components.Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                forest.joins(i, j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[forest.find(i)].append(i)
    least = {i: min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups.values() for i in g}
    return Counter((rows[i][0], len(s), least[i]) for i, s in enumerate(sets))


def edited(rng, words, n):
    out = list(words)
    for at in rng.integers(0, len(out), n):
        out[at] = f"e{rng.integers(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [vocabulary[i] for i in rng.integers(0, 300, 60)]
    base = [vocabulary[i] for i in rng.integers(0, 300, 120)]
    texts = [edited(rng, base, int(rng.integers(0, 4))) for _ in range(320)]
    # A passage in texts that are otherwise their own, and chains of edits that drift away from where they began.
    texts += [" ".join(vocabulary[i] for i in rng.integers(0, 300, 40)) + " " + " ".join(passage) for _ in range(120)]
    drift = " ".join(vocabulary[i] for i in rng.integers(0, 300, 90))
    for _ in range(40):
        drift = edited(rng, drift.split(" "), 1)
        texts.append(drift)
    texts += ["", None, "  \t ", "one", "One two", "one two", "a b c d", "A  b\tc\nd", "x " * 4000, "y " * 4001]
    rows = [(int(i), t, "en") for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    return rows + [rows[0], rows[-1], (None, "all on its own here it is", None), (None, texts[3], None)]


def test_prefix_trie_is_all_pairs(spark, copies, monkeypatch):
    want = linked_by_force(copies, 4, 85)
    docs = table(spark, copies).repartition(3)
    assert Counter(map(tuple, prefix_trie.jaccard_components(docs).collect())) == want
    # Small nodes, blocks and buckets, and no pivots: groups are joined whole, in blocks.
    for name, value in {"NODE": 16, "PIVOTS": 0, "BLOCK_TOKENS": 2000, "BUCKET_BYTES": 1 << 12, "SLOT": 8}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    assert Counter(map(tuple, prefix_trie.jaccard_components(docs).collect())) == want


def test_prefix_trie_at_another_threshold(spark, copies):
    rows = copies[300:]
    assert Counter(map(tuple, prefix_trie.jaccard_components(table(spark, rows), 2, 60).collect())) == linked_by_force(rows, 2, 60)
    assert prefix_trie.jaccard_components(table(spark, [])).count() == 0
    assert [tuple(r) for r in prefix_trie.jaccard_components(table(spark, [(1, None, None)])).collect()] == [(1, 0, 1)]


def test_trie_finds_each_linked_member():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(60, int(rng.integers(1, 40)), replace=False)) for _ in range(150)]
    trie = prefix_trie.Trie(sets, [len(s) for s in sets], list(range(len(sets))), 50)
    for i, own in enumerate(sets):
        both = [len(np.intersect1d(own, s)) for s in sets]
        want = {j for j, s in enumerate(sets) if j != i and 100 * both[j] >= 50 * (len(own) + len(s) - both[j])}
        assert set(trie.join(own, len(own), i, 60, components.Forest())) == want


def phrases_by_force(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        best = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                longer = [f[q] for q in f if len(q) > len(p) and f[q] >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                if not any(100 * x >= 80 * a for x in longer):
                    best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, b[2].decode(), -b[1], b[3], b[4], n[lang], -b[0]) for i, b in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_collocations_are_those_of_all_runs(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "CHUNK", block)
    rng = np.random.default_rng(3)
    words = ["New", "york", "Ünï", "the", "of", "\x1c", "a\x00b", "don't", "漢字", "x"]
    rows = []
    for i in range(60):
        text = " ".join(words[j] for j in rng.choice(len(words), 80, p=np.arange(1, 11) / 55))
        rows.append((i, text.replace(" x the", ". x\tthe,").replace("of of", "of\rof"), ["en", "fr", None, ""][i % 4]))
    rows += [(None, None, "en"), (7, "", "de"), (8, " . ,", "de"), rows[0], (9, "the new york " * 400, "en")]
    got = sorted(map(tuple, collocations.collocations(table(spark, rows), 4, 25).collect()))
    assert got == phrases_by_force(rows, 4, 25)
    assert collocations.collocations(table(spark, [])).count() == 0


def test_quicksort_counts_leading_words():
    rng = np.random.default_rng(4)
    columns = [rng.integers(1, 6, 400).astype(np.uint64), rng.integers(0, 4, 400).astype(np.uint64)]
    weights, found = rng.integers(1, 4, 400), {}
    collocations.multikey_counts(columns, weights, 12, lambda n, at, f: found.__setitem__(tuple(int(c[at]) for c in columns[:n]), f))
    want = Counter()
    for a, b, w in zip(*columns, weights, strict=True):
        want[int(a),] += int(w)
        if b:
            want[int(a), int(b)] += int(w)
    assert found == {k: f for k, f in want.items() if f >= 12}


def audit_by_force(rows, labels):
    first, good, toxic = {}, Counter(), Counter()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        good[i] |= q == 1
        toxic[i] |= x == 1
    judged = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        judged.append((lang or "", {f for f in fails if fails[f]}, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out, shapley = [], Counter()
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                redundant = sum(f in j[1] and bool(j[1] & set(order[:step])) for j in own)
                only = sum(j[1] == {f} for j in own)
                out.append((part, "".join(order), step + 1, len(left), len(gone), redundant, only, sum(j[2] for j in gone), sum(j[3] for j in gone)))
                shapley[part, f] += len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_is_that_of_every_order(spark):
    long = " ".join(f"w{i}" for i in range(220))
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(long, "en"), (long, "en"), (long + " $", None), ("ab " * 300, "en"), ("LOUD " * 10, "fr"), ("", ""), (None, "fr"), (long, None)])]
    rows += [rows[1], (None, long, "en"), (None, None, None), (40, "Ünï\x1cA" * 5000, "fr"), (3, "LOUD " * 10, "fr")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (4, None, 1), (None, 1, 1), (40, 1, None), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    got = filter_audit.audit(table(spark, rows), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audit_by_force(rows, labels)
    assert filter_audit.audit(table(spark, []), marks.limit(0)).count() == 0
