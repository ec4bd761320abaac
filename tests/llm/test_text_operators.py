"""Text operators against the libraries, brute force and exact round trips; edge cases of every column."""

import base64
import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobsight.llm import digest, direct_codes, language, near_dup, packing, piece_bpe, sharding, token_counts, toxicity

TEXTS = [
    "the quick brown fox jumps over the lazy dog near the old river bank today",
    "the quick brown fox jumps over the lazy dog near the old river bank today",
    "the quick brown fox jumps over the lazy dog near the old river bank todays",
    "",
    None,
    "  two  spaces \n\n and\ttabs, don't <|endoftext|> stop.  ",
    "Ünïcode İ漢字 👍🏽   x\x1cy",
    "a" * 5000,
    "word, " * 3000,
    "one two",
]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING, bucket STRING, node STRING"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns with the names of the operators' own, null ids, and a row that repeats."""
    rows = [(i, t, "en", "s", 1, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, "lonely null id text of some words", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def few_labels(spark):
    return spark.createDataFrame([(0, 1, 1), (5, 0, 0), (7, None, None), (None, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")


def all_texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_round_trip_is_that_of_the_library(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text in all_texts(docs):
        ids = own.encode_ordinary(text)
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert Counter(map(tuple, piece_bpe.round_trip(docs).collect())) == Counter(want)
    back = piece_bpe.decode(piece_bpe.encode(docs)).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.lang in ("en", None) for r in back)
    assert piece_bpe.round_trip(none).count() == 0


def test_every_entry_is_one_piece():
    tool = piece_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    letters = tool._shown
    shown = [e.decode("latin-1").translate(letters) for e in tool.entries]
    assert tool._pieces.encode(shown, num_threads=1) == [[i] for i in range(len(shown))]


def test_token_counts_are_those_of_the_library(docs, none):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text in all_texts(docs):
        n = len(own.encode(text, add_special_tokens=False).ids)
        want.append((doc, len(text.encode()), n, n > 512))
    assert Counter(map(tuple, token_counts.count_tokens(docs).collect())) == Counter(want)
    assert token_counts.count_tokens(none).count() == 0


def test_direct_codes_give_any_token():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << w, 700) for w in (1, 8, 9, 16, 17, 31)]).astype(np.uint32)
    rng.shuffle(ids)
    codes = direct_codes.Codes(direct_codes.pack(ids))
    assert [codes.token(i) for i in range(len(ids))] == ids.tolist()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2))
        assert codes.run(a, b).tolist() == ids[a:b].tolist()
    assert len(direct_codes.Codes(direct_codes.pack(ids[:0]))) == 0


def test_files_hold_documents_in_order(docs, none, monkeypatch):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for doc, text in sorted(all_texts(docs), key=lambda r: (r[0] is not None, r)):
        ids = own.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(map(tuple, direct_codes.stored_digests(docs).collect()), key=lambda r: r[1])
    assert got == want
    assert direct_codes.stored_digests(none).count() == 0


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_covers_every_piece(docs, none):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text in all_texts(docs):
        ids = own.encode(text, add_special_tokens=False).ids + [0]
        starts = packing.cut(len(ids), packing.CAPACITY)
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    packed = packing.pack_documents(docs)
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    sequences, bound = packing.certificate(packed)
    assert check_packed(rows, packing.CAPACITY) == sequences >= bound
    assert packing.pack_documents(none).count() == 0


def test_exchange_closes_gaps(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(20, 60, 3000).tolist()
    table = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id BIGINT, length BIGINT")
    alone = packing.pack(table, 100, group_pieces=100, rounds=1)
    exchanged = packing.pack(table, 100, group_pieces=100, rounds=4)
    rows = exchanged.collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert packing.lower_bound(np.array(lengths), 100) <= check_packed(rows, 100) < check_packed(alone.collect(), 100)


def test_bounds_hold_on_small_cases():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 9)))[::-1]

        def fewest(rest, bins):
            if not len(rest):
                return len(bins)
            best = fewest(rest[1:], [*bins, 20 - rest[0]])
            for i, room in enumerate(bins):
                if room >= rest[0]:
                    best = min(best, fewest(rest[1:], [*bins[:i], room - rest[0], *bins[i + 1 :]]))
            return best

        assert packing.lower_bound(lengths, 20) <= fewest(lengths.tolist(), []) <= len(packing.best_fit_decreasing(lengths, 20)[2])


def plain_jump(key, shards):
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b, key = j, (key * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(spark, docs, none):
    keys = [*range(200), -1, -5, 2**62, -(2**63), 2**63 - 1]
    table = spark.createDataFrame([(k,) for k in keys], "k BIGINT")
    got = table.select("k", *[sharding.jump(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 16, 17)]).collect()
    assert all(r[f"n{n}"] == plain_jump(r.k, n) for r in got for n in (1, 2, 16, 17))
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.shard) == (len(raw) + 1, zlib.crc32(raw), plain_jump(r.doc_id or 0, 16))
        assert r.grown_shard in (r.shard, 16)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def brute_components(texts, width, percent):
    sets = {}
    for doc, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        k = min(width, len(words))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts, base = [], rng.choice(words, 120).tolist()
    for i in range(260):
        if i % 2:
            text = rng.choice(words, rng.integers(0, 90)).tolist()
        else:
            # A dense group: copies with none to some words replaced.
            text = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 7)):
                text[at] = str(rng.choice(words))
        texts.append((i, " ".join(text).upper() if i % 5 == 0 else "\n".join(text)))
    want = brute_components(texts, 3, 85)
    table = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    for limit, block in ((48, 256), (8, 16)):
        monkeypatch.setattr(near_dup, "NODE_LIMIT", limit)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table, 3, 85).collect()}
        assert got == want


def test_near_duplicates_of_odd_rows(docs, none):
    rows = near_dup.near_duplicates(docs, 3, 85).collect()
    groups = {r.doc_id: (r.component_id, r.kept) for r in rows}
    assert len(rows) == docs.count()
    assert groups[0] == (0, True) and groups[1] == (0, False) and groups[2] == (0, False)
    assert groups[3] == (3, True) and groups[4] == (4, True) and groups[None] == (None, True)
    kept = near_dup.one_per_group(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 6, 7, 8, 9]
    assert near_dup.near_duplicates(none).count() == near_dup.one_per_group(none).count() == 0


def test_language_of_held_out_texts(spark, docs, none):
    rng = np.random.default_rng(6)
    stems = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "eit", "er"], "cc": ["ción", "que", "los", "ar"]}
    rows = []
    for i in range(240):
        lang = sorted(stems)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang], 3)) for _ in range(30)), lang))
    rows += [(900, None, None), (901, "123 !!", "aa"), (902, "", "bb")]
    got = {r.doc_id: r for r in language.predictions(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:240])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.predictions(docs).count() == docs.count()
    assert language.predictions(none).count() == 0
    assert {r.lang_pred for r in language.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_samples_hold_neither_copies_nor_openings_alone(spark):
    rng = np.random.default_rng(11)
    parts = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ein", "ung", "ver", "ach"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(n))

    opening = text("bb", 100)
    # The rare language opens with words of the other, and one text, mostly of foreign words, is most of its rows.
    rows = [(i, text("bb", 150), "bb") for i in range(400)]
    rows += [(1000 + i, f"{opening} {text('aa', 600)}", "aa") for i in range(60)]
    rows += [(2000 + i, f"{text('bb', 1)} 1234", "aa") for i in range(2)] + [(3000 + i, opening, "aa") for i in range(3000)]
    rows += [(9000 + i, "12 34 ...", "aa") for i in range(300)] + [(9500, "", "aa"), (9501, None, "aa")]
    rows += [(20000 + i, text("aa", 60), None) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    sample = dict(language.samples_of(table))["aa"]
    assert len(sample) > 60 * 250 and sample.count(opening[:200]) <= 5
    got = {r.doc_id: r.lang_pred for r in language.predictions(table.filter("doc_id < 2000 OR doc_id >= 3000")).collect()}
    assert sum(got[20000 + i] == "aa" for i in range(50)) == 50
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % language.FOLDS == language.HELD_OUT]
    assert held and all(got[i] == "bb" for i in held)


def test_phrases_are_greedy_longest_matches():
    rng = np.random.default_rng(7)
    known = "".join(rng.choice(list("abc"), 300))
    automaton = language.SuffixAutomaton(known)
    for _ in range(100):
        text, n, at = "".join(rng.choice(list("abcd"), 40)), 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in known:
                end += 1
            n, at = n + 1, end
        assert automaton.phrases(text) == n


def test_toxic_words_in_disguise(spark, docs, few_labels, none):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(["the", "an", "ri", "on", "ed", "ly"], 2)) for _ in range(300)]
    insults = ["moron", "stupid", "loser"]
    rows, labels = [], []
    for i in range(900):
        text = rng.choice(words, 40).tolist()
        if i % 4 == 0:
            for at in rng.integers(0, 40, 2):
                text[at] = str(rng.choice(insults))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    hidden = ["m0ron", "st00pid stupiiiid", "l o s e r", "$tup1d!!", "m-o-r-o-n", "LOSER."]
    rows += [(5000 + k, f"{' '.join(words[:20])} {w} {' '.join(words[20:40])}") for k, w in enumerate(hidden)]
    rows += [(6000, None), (6001, ""), (6002, " ".join(words[:50])), (6003, "a b c d e f g h 1 2 3 4 !!! ...")]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in toxicity.predictions(table, spark.createDataFrame(labels, "doc_id BIGINT, toxic INT")).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert held and all(got[i].predicted == int(i % 4 == 0) for i in held)
    assert all(got[5000 + k].predicted == 1 for k in range(len(hidden)))
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in (6000, 6001, 6002, 6003))
    assert toxicity.predictions(docs, few_labels).count() == docs.count()
    assert toxicity.predictions(none, few_labels).count() == toxicity.predictions(none, few_labels.limit(0)).count() == 0
    assert toxicity.clean(docs, toxicity.fit(docs, few_labels)).columns == docs.columns


@pytest.fixture(scope="module")
def insulted(spark):
    """A fitted model of texts with insults among made-up and common words, and clean texts of the others."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(["the", "an", "ri", "on", "ed", "ly"], 2)) for _ in range(300)] + ["you", "are", "a", "and", "i"] * 10
    insults = ["moron", "stupid", "loser", "idiot", "pathetic", "fool", "ass"]
    rows = []
    for i in range(1400):
        text = rng.choice(words, 40).tolist()
        if i % 4 == 0:
            for at in rng.integers(0, 40, 2):
                text[at] = str(rng.choice(insults))
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    return toxicity.Scorer(*toxicity.fit(table.drop("toxic"), table.drop("text")))


def test_words_on_one_stem_are_learned_together(spark):
    ends = [a + b for a in "abcdeflmnorst" for b in "aeioubdgk"]
    rng = random.Random(3)
    plain = ["theri", "onan", "anly", "oure", "tisha", "endro"]

    def text(words, length=60):
        line = rng.choices(plain, k=length) + words
        rng.shuffle(line)
        return " ".join(line)

    rows = [(i, text(["vorglich" + e for e in rng.sample(ends, 4)]), 1) for i in range(60)]
    rows += [(100 + i, text(["vorglich" + rng.choice(ends)] if i % 3 == 0 else []), 0) for i in range(300)]
    rows += [(500 + i, text(["loserna" if i % 2 else "loserti"]), 0) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    scorer = toxicity.Scorer(*toxicity.fit(table.drop("toxic"), table.drop("text")))
    assert all(called_toxic(scorer, *(text([f"vorglich{e}{e}%%" for e in rng.sample(ends, 3)]) for _ in range(20))))
    one = [text(["vorglich" + e]) for e in ends] + [text(["vorglichab"] * 5)]
    # In a long text words of one stem far from each other are chance.
    far = " ".join(f"vorglich{e} " + " ".join(rng.choices(plain, k=400)) for e in ends[:40])
    assert not any(called_toxic(scorer, *one, far, ""))


@pytest.mark.parametrize("seed", range(20))
def test_gathered_equals_all_windows(seed):
    rng = random.Random(seed)
    length = rng.choice([50, 300, 3000])
    found = sorted({(rng.randrange(length), rng.choice("abcde")) for _ in range(rng.randrange(12))})
    chance = max(0, round(math.log10(length / toxicity.WINDOW)))
    most = max((len({w for i, w in found if at <= i < at + toxicity.WINDOW}) for at in range(length)), default=0) - chance
    assert [f for f, _ in toxicity.gathered({"stem": found}, length)] == [f"stem~{n}" for n in toxicity.LEVELS if most >= n]


def test_every_labelled_row_is_learned_from(spark):
    """An insult that few rows beyond the first 12,000 have, and words that only their number makes frequent."""
    ids = spark.range(24_000).withColumn("doc_id", F.col("id")).withColumn("n", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))
    rare = (F.col("n") > 21_000) & (F.col("doc_id") % 7 == 0)
    common = F.when(F.col("doc_id") % 2400 == 0, F.concat(F.lit(" id ot v"), F.col("doc_id"))).otherwise("")
    text = F.concat(F.lit("theri onan "), F.when(rare, F.concat(F.lit("w"), F.col("n"), F.lit(" moron v"), F.col("n"))).otherwise("anly"), common)
    table = ids.select("doc_id", text.alias("text"), rare.cast("int").alias("toxic")).cache()
    rows = toxicity._fit_rows(table.drop("toxic"), table.drop("text"))
    assert rows.count() == table.filter(language.fold(toxicity.FOLDS) != toxicity.HELD_OUT).count() > 12_000
    model, weights, _ = toxicity.fit(table.drop("toxic"), table.drop("text"))
    assert "moron" in weights and "theri" in model.words and "ot" not in model.words


def test_tasks_of_a_worker_share_restored_words():
    one, other = toxicity.CharModel({"^^a": 1, "^a$": 1}), toxicity.CharModel({"^^a": 1, "^a$": 1})
    toxicity.readings("a-a", toxicity.remembering(one))
    again = pickle.loads(pickle.dumps(one))
    assert toxicity.remembering(again).restored is one.restored and "a-a" in one.restored
    assert not toxicity.remembering(other).restored


def test_a_task_counts_its_clean_rows_before_it_gives_them_out(spark):
    """More rows than one slice holds give one row a feature, and the counts of both parts make up those of all rows."""
    rows = spark.range(0, 9000, 1, 1).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "theri moron").when(F.col("id") % 3 == 1, "theri m0ron%%").otherwise("theri anly!!").alias("text"),
        F.lit(0).alias("toxic"),
    )
    model = toxicity.CharModel(toxicity.trigrams(["moron", "theri", "anly"]), {"moron": 60, "theri": 90, "anly": 30})
    found = toxicity._rows_with(rows.select("text"), model, frozenset(["moron", "theri", "idiot"])).collect()
    assert sorted((r.feature, r.n) for r in found) == [("moron", 6000), ("theri", 9000)]
    counts = toxicity._clean_counts(rows, model, {"moron": 20_000, "theri": 50, "idiot": 6})
    # An ordinary word is left after the first part; what many toxic rows have is counted to the end.
    assert counts["moron"] == 6000 and 50 < counts["theri"] < 9000
    assert toxicity.undecided({"moron": 20_000, "theri": 50, "idiot": 6}, counts) == {"moron"}


@pytest.mark.parametrize("seed", range(5))
def test_dull_words_have_no_reading_that_begins_like_a_feature(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeilost", k=rng.randrange(1, 9))) for _ in range(60)]
    model = toxicity.CharModel(toxicity.trigrams(words), {w: 9 for w in words[::2]})
    features = [*rng.sample(words, 12), "lose~", "tool~2"]
    dull, skipped = toxicity.Dull(features), 0
    for _ in range(4000):
        word = "".join(c * rng.choice([1, 1, 1, 2, 3]) for c in rng.choice([*words, "loser", "tools"]))
        word = rng.choice(["", "(", '"']) + rng.choice([word, word.upper()]) + "".join(rng.choices("$!.,*@|+(€3-", k=rng.randrange(5)))
        if dull(word):
            skipped += 1
            assert not any(r[:4] in dull.beginnings for r in toxicity.readings(word, model)), word
    assert skipped > 200


def test_counts_of_letters_and_rows_equal_plain_counts():
    texts = ["theri Anly, theri", "", "ünly the-ri 7x x²y", "a漢字b  anly\n\ttheri"]
    parts, rows_of = toxicity.rows_with_parts(pa.array(texts))
    plain = Counter(x for t in texts for x in set(re.findall(r"[^\W\d_]+", t.lower())))
    assert dict(zip(parts, rows_of.tolist(), strict=True)) == plain
    assert toxicity.trigrams(parts) == Counter(f"^^{w}$"[i : i + 3] for w in parts for i in range(len(w) + 1))
    assert toxicity.rows_with_parts(pa.array([], pa.string()))[0] == [] and toxicity.trigrams([]) == {}


def test_beginnings_that_only_one_word_explains_are_dropped():
    weights = {"lose~": 0.74, "loser": 0.93, "idio~": 0.94, "idiot": 0.94}
    kept = toxicity.telling_beginnings(weights, {"lose~": 86, "loser": 86, "idio~": 97, "idiot": 95}, {"lose~": 9})
    assert set(kept) == {"loser", "idio~", "idiot"}


def called_toxic(scorer, *texts):
    return [s >= toxicity.THRESHOLD for s in scorer.scores(pa.array(texts))]


def test_disguise_of_any_length(insulted):
    long = ["idi" + "o" * 60 + "t", "st" + "u" * 5000 + "pid", "m" * 70 + "0" + "r" * 70 + "on"]
    assert all(called_toxic(insulted, *long, *(f"theri {w} anly" for w in long)))
    assert not any(called_toxic(insulted, "theri" * 4000, "t-h-e-r-i" * 400, "a" * 5000))


def test_spelt_runs_of_several_words(insulted):
    spelt = ["you are a l o s e r", "i d i o t a n d f o o l", "y o u a r e p a t h e t i c", "I a m a n i d i o t", "l o s e r  i d i o t"]
    assert all(called_toxic(insulted, *spelt, " ".join("theri" * 60) + " i d i o t"))
    assert not any(called_toxic(insulted, "y o u a r e", "t h e r i a n d o n e d", "a b c d e f g"))
    assert toxicity.decoded("i d i o t a n d f o o l", insulted._model) == ["idiot", "and", "fool"]
    # Contexts of spelt words differ, so such words can be learned.
    seen = {a for i in range(9) for f, a in toxicity._seen(f"w{i} i d i o t v{i}", insulted._model, {}) if f == "idiot"}
    assert len(seen) == 9


def test_disguise_of_every_kind(insulted):
    hidden = ["iiddiioott", "id-iot", "idi.ot", "a.s.s", "a s s", "@$$", "a$$", "iid10t", "f-oo-l", "p@th.et1c!", "(l,o,s,e,r)"]
    missed = [w for w, toxic in zip(hidden, called_toxic(insulted, *(f"theri {w} anly" for w in hidden)), strict=True) if not toxic]
    assert not missed
    assert not any(called_toxic(insulted, "theri 108.51.216.133 2024-05-06 12.50", "$$$ !!! | + ***", "theri! an-ri (onan) theeri"))


def test_entropies_and_fingerprints(spark, docs, none):
    rng = np.random.default_rng(9)
    data = rng.integers(97, 101, 300).astype(np.uint8)
    bins = digest.entropy_bins(data)
    for at in range(len(bins)):
        p = np.bincount(data[at : at + digest.WINDOW]) / digest.WINDOW
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / np.log2(digest.WINDOW)
        assert abs(bins[at] - entropy * (digest.BINS - 1)) <= 1
    rows = digest.compared(docs).collect()
    order = sorted(all_texts(docs), key=lambda r: (r[0] is not None, r))
    following = dict(zip(order, order[1:] + order[:1], strict=False))
    assert len(rows) == len(order)
    prints = {}
    for r in rows:
        texts = [t for d, t in order if d == r.doc_id]
        options = {hashlib.sha256(digest.edited(t, following[(r.doc_id, t)][1]).encode()).hexdigest() for t in texts}
        assert r.doc_id == 0 or r.edited_sha256 in options
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.n_chars == len(texts[0])
        assert prints.setdefault(texts[0], r.fingerprint) == r.fingerprint
    assert digest.compared(none).count() == 0
    assert {r.near_next for r in digest.compared(docs.limit(1)).collect()} == {1.0}


def test_likeness_tells_edited_from_other():
    rng = np.random.default_rng(10)
    tool = digest.Digester(np.arange(digest.BINS)[::-1])
    texts = ["".join(rng.choice(list("abcdefghijklmnop "), n)) for n in (60, 300, 2000, 40000)]
    for text, other in zip(texts, reversed(texts), strict=True):
        a, b, c = tool.fingerprints([t.encode() for t in (text, digest.edited(text, other), other)])
        assert digest.likeness(a, a) == 1 and digest.likeness(a, b) > 0.4 + digest.likeness(a, c) * (text != other)
        assert (digest.read(digest.shown(a)) == a).all()


def test_parts_are_independent_of_each_other():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(11)
    bits = [" ", "  ", "\n", "\t", " \n", "a", "the", "'s", "1", "é", "漢", "\xa0", "\x1c", "İ", "<|endoftext|>", "!", ".", ",", "́", "👍"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 20))) for _ in range(3000)]
    ids, bounds = direct_codes.word_ids(public_tokenizers.path("byte_bpe_50k.json"), True).ids(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert own.encode(text, add_special_tokens=False).ids == ids[a:b].tolist()


@pytest.mark.parametrize("name, glued", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_with_signs_behind_them_are_encoded_as_the_library_does(name, glued):
    rng = random.Random(5)
    words = ["Thor", "reais", "ciónñ", "don't", "x²", "µm", "ªº", "İi", "漢", "7", "a_b", "<|endoftext|>x", "é\u0301e", ""]
    ends = [" ", " ", " ", "\n", "\n\n", " \n"]
    texts = ["".join(rng.choice(words) + "".join(rng.choices(".,!?:;$%&*#'", k=rng.randrange(4))) + rng.choice(ends) for _ in range(30)) for _ in range(60)]
    tool = direct_codes.WordIds(public_tokenizers.path(name), glued)
    # Signs behind a word cost no call of the whole tokenizer.
    sent, encoded = [], tool._encoded
    tool._encoded = lambda parts: sent.extend(parts) or encoded(parts)
    flat, bounds = tool.ids(pa.array(texts))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == expected
    assert tool._direct and not any(re.fullmatch(r" ?(Thor|reais)[.,!?:;$%&*#]*", p) for p in sent)
    assert glued or not any("\n" in p for p in sent)
