"""Documents whose n-gram sets have a Jaccard similarity of at least a threshold: an exact join over prefix trees.

1. A text becomes its set of n-grams (64-bit hashes of word runs). Tokens are dealt by value into buckets of bounded size,
   where each is counted over the sets of all documents; those in one set only are dropped, as no intersection holds
   them. What comes back to a set is its shared tokens with their counts. A token that many sets of a block hold goes out
   once a block, so a passage in a third of all documents does not fill one bucket.
2. A set can be linked only if at least the threshold's part of its tokens is shared; few documents get further. Equal
   sets are one class. All sets are ordered alike, by count and then by value. Two linked sets have a token in common among
   the rarest of each, so many that what follows is too short for a link: these are the leads of a set, and the classes of
   one lead are a group.
3. Groups are joined in tries. A trie holds the sets of its members in the common order, frequent tokens first, so what
   members begin with is stored once. A set that is looked up goes down the trie with its overlap so far, shared by all
   members below; it turns back where the tokens left in either could not make a link, where sizes rule it out, and where
   all members below are in its own component already.
4. First every group meets its pivots only, one or two of its classes: copies of one text become a component here, and a
   group within one component is done. What is still open is joined whole, equal groups once, groups over ``NODE``
   members in blocks of which every two meet. So no pair of a group is left out, and no group is held in one task.

All links are exact on the sets. Null, empty and blank texts have an empty set and are linked with nothing; a text with
fewer words than an n-gram is one n-gram of all its words. Very long texts are read whole, a block of their own. Repeated
rows are equal sets, even with the same doc_id. A null doc_id never is a component's id unless all its members' are null.
Sizes that tie, overlaps on the threshold are links. Extra columns do not matter; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobsight.llm.batches import filled, packed, slices, small_batches, unpacked
from jobsight.llm.components import Forest, components
from jobsight.llm.near_dup import Shingler
from jobsight.llm.ordering import shuffle_width
from jobsight.session import stored

WIDTH, PERCENT = 4, 85
#: Members of one trie, pivots that a group meets before it is joined whole, and members of a pivot in one task.
NODE, PIVOTS, SLOT = 256, 2, 4096
#: Tokens of one block of documents, and bytes of text whose tokens share a bucket.
BLOCK_TOKENS, BUCKET_BYTES = 1_000_000, 8 << 20
#: Owner of a token that several sets of its block hold.
_SEVERAL = 0xFFFFFFFF


def least_overlap(n, percent: int):
    """Tokens that a set of ``n`` shares at least with any set linked with it."""
    return -(-percent * n // 100)


def needed(n, m, percent: int):
    """Least overlap of linked sets of sizes ``n`` and ``m``."""
    return -(-percent * (n + m) // (100 + percent))


def _binary(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.BinaryType()) for name in names]


def _records(schema: T.StructType, rows: dict[str, list]) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)


def _pieces_schema(docs: DataFrame) -> T.StructType:
    ids = T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))
    head = [T.StructField("bucket", T.IntegerType()), T.StructField("block", T.LongType()), ids]
    return T.StructType([*head, *_binary("which", "digests", "sizes", "owners", "tokens", "counts")])


def _dealt(docs: DataFrame, width: int, buckets: int, schema: T.StructType) -> DataFrame:
    """Per block of documents: its directory (ids, place, digest and size of each set, tokens that several sets hold) and a
    row per bucket with the tokens there, their owners, and for shared ones how many own them."""

    class Block:
        def __init__(self):
            self.ids, self.which, self.places, self.digests, self.sets, self.size = [], [], {}, [], [], 0

        def add(self, doc_id, own: np.ndarray) -> None:
            self.ids.append(doc_id)
            digest = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
            place = -1 if digest is None else self.places.setdefault(digest, len(self.places))
            self.which.append(place)
            if place == len(self.sets):
                self.digests.append(digest)
                self.sets.append(own)
                self.size += len(own)

        def rows(self, number: int) -> dict[str, list]:
            sizes = np.array([len(s) for s in self.sets], np.int64)
            tokens = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
            owners = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            starts = np.flatnonzero(np.concatenate([tokens[:1] == tokens[:1], tokens[1:] != tokens[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(tokens)]]))
            several = np.repeat(counts > 1, counts)
            directory = owners[several].tobytes(), tokens[several].tobytes()
            sent = np.where(counts > 1, _SEVERAL, owners[starts]).astype(np.uint32)
            tokens = tokens[starts]
            bucket = (tokens % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((sent, bucket))
            tokens, sent, counts, bucket = tokens[order], sent[order], counts[order].astype(np.uint32), bucket[order]
            which = np.array(self.which, np.int32).tobytes()
            out = {"bucket": [number % buckets], "block": [number], "ids": [self.ids], "which": [which], "digests": [b"".join(self.digests)]}
            out |= {"sizes": [sizes.tobytes()], "owners": [directory[0]], "tokens": [directory[1]], "counts": [None]}
            cuts = np.flatnonzero(np.concatenate([bucket[:1] >= 0, bucket[1:] != bucket[:-1]])).tolist() + [len(bucket)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                row = {"bucket": int(bucket[a]), "block": number, "ids": None, "which": None, "digests": None, "sizes": None}
                row |= {"owners": packed(sent[a:b]), "tokens": tokens[a:b].tobytes(), "counts": packed(counts[a:b])}
                for name, value in row.items():
                    out[name].append(value)
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, block, number = Shingler(width), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), filled(part.column("text")).to_pylist(), strict=True):
                    block.add(doc_id, tool.shingles(text))
                    if block.size >= BLOCK_TOKENS:
                        yield _records(schema, block.rows(number))
                        block, number = Block(), number + 1
        if block.ids:
            yield _records(schema, block.rows(number))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _u(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, kind)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Consecutive rows with equal keys."""
    held, rows = None, []
    for batch in batches:
        for row in (r for part in slices(batch, "tokens") for r in part.to_pylist()):
            key = [row[k] for k in keys]
            if key != held and rows:
                yield rows
                rows = []
            held = key
            rows.append(row)
    if rows:
        yield rows


def _counted(pieces: DataFrame, schema: T.StructType) -> DataFrame:
    """The directories as they are, and of every other piece the tokens that more than one set holds, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["bucket"]):
            parts = [r for r in rows if r["ids"] is None]
            out = [r for r in rows if r["ids"] is not None]
            if parts:
                tokens = [_u(r["tokens"], np.uint64) for r in parts]
                values, place = np.unique(np.concatenate(tokens), return_inverse=True)
                total = np.bincount(place, np.concatenate([unpacked(r["counts"], np.uint32) for r in parts]), len(values)).astype(np.int64)
                at = 0
                for r, own in zip(parts, tokens, strict=True):
                    count = total[place[at : at + len(own)]]
                    at += len(own)
                    shared = count > 1
                    if shared.any():
                        owners = unpacked(r["owners"], np.uint32)[shared]
                        out.append(r | {"owners": packed(owners), "tokens": own[shared].tobytes(), "counts": packed(count[shared])})
            for a in range(0, len(out), 64):
                yield _records(schema, {f.name: [r[f.name] for r in out[a : a + 64]] for f in schema})

    width = shuffle_width(pieces)
    return pieces.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _sets(counted: DataFrame, percent: int) -> DataFrame:
    """A row per document (doc_id, n_shingles, digest), and one per set that may have links, with its shared tokens in the
    common order, rarest first, and their counts."""
    ids = counted.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("n_shingles", T.LongType()), *_binary("digest", "tokens", "counts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["block"]):
            head = next(r for r in rows if r["ids"] is not None)
            parts = [r for r in rows if r["ids"] is None]
            owners = np.concatenate([unpacked(r["owners"], np.uint32) for r in parts] or [np.zeros(0, np.uint32)])
            tokens = np.concatenate([_u(r["tokens"], np.uint64) for r in parts] or [np.zeros(0, np.uint64)])
            counts = np.concatenate([unpacked(r["counts"], np.int64) for r in parts] or [np.zeros(0, np.int64)])
            several = owners == _SEVERAL
            order = np.argsort(tokens[several])
            known, known_counts = tokens[several][order], counts[several][order]
            more = _u(head["tokens"], np.uint64)
            owners = np.concatenate([owners[~several], _u(head["owners"], np.uint32)])
            counts = np.concatenate([counts[~several], known_counts[np.searchsorted(known, more)]])
            tokens = np.concatenate([tokens[~several], more])
            sizes = _u(head["sizes"], np.int64)
            digests = [head["digests"][i : i + 16] for i in range(0, len(head["digests"]), 16)]
            shared = np.bincount(owners, minlength=len(sizes))
            active = shared >= least_overlap(sizes, percent)
            keep = active[owners]
            owners, tokens, counts = owners[keep], tokens[keep], counts[keep]
            order = np.lexsort((tokens, counts, owners))
            owners, tokens, counts = owners[order], tokens[order], counts[order]
            chosen = np.flatnonzero(active)
            bounds = np.searchsorted(owners, [chosen, chosen + 1]).T.tolist()
            which = _u(head["which"], np.int32).tolist()
            out = {
                "doc_id": head["ids"] + [None] * len(chosen),
                "n_shingles": [0 if w < 0 else int(sizes[w]) for w in which] + sizes[chosen].tolist(),
                "digest": [None if w < 0 else digests[w] for w in which] + [digests[c] for c in chosen],
                "tokens": [None] * len(which) + [tokens[a:b].tobytes() for a, b in bounds],
                "counts": [None] * len(which) + [counts[a:b].tobytes() for a, b in bounds],
            }
            for a in range(0, len(out["doc_id"]), 4096):
                yield _records(schema, {name: column[a : a + 4096] for name, column in out.items()})

    return counted.repartition(shuffle_width(counted), "block").sortWithinPartitions("block").mapInArrow(run, schema)


def shared_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Documents and the sets that may have links, as ``_sets`` gives them, stored."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    schema = _pieces_schema(docs)
    pieces = _dealt(docs, width, max(shuffle_width(docs), -(-size // BUCKET_BYTES)), schema)
    with small_batches(docs.sparkSession):
        return stored(_sets(_counted(pieces, schema), percent), "sets")


class Trie:
    """Sets as paths from the root, runs without a branch as one node; a node knows the bounds of what is below."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], homes: list[int], percent: int):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self._sets, self.sizes, self.homes, self._percent = [sets[i] for i in order], [sizes[i] for i in order], [homes[i] for i in order], percent
        # Tokens that each set has in common with the one before.
        self._common = [0] + [self._prefix(a, b) for a, b in zip(self._sets, self._sets[1:], strict=False)]
        self._root = self._node(0, len(sets), 0)

    @staticmethod
    def _prefix(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, lo: int, hi: int, start: int) -> tuple:
        """(run of tokens, overlap possible below, least size, largest size, members from, members to, from where they go on)."""
        end = min(self._common[lo + 1 : hi], default=len(self._sets[lo]))
        longest = max(len(s) for s in self._sets[lo:hi])
        sizes = self.sizes[lo:hi]
        return self._sets[lo][start:end], longest - end, min(sizes), max(sizes), lo, hi, end

    def _children(self, node: tuple) -> tuple[list[int], list[tuple]]:
        """Members that end at a node, and the nodes below it."""
        lo, hi, end = node[4:]
        own = [i for i in range(lo, hi) if len(self._sets[i]) == end]
        # Members that end here come before those that go on.
        cuts = [i for i in range(lo + len(own), hi) if i == lo or self._common[i] <= end]
        return own, [self._node(a, b, end) for a, b in zip(cuts, [*cuts[1:], hi], strict=False)]

    def join(self, probe: np.ndarray, size: int, home: int, universe: int, forest: Forest) -> Iterator[int]:
        """Homes of members linked with the probe and not yet in its tree of the forest."""
        percent = self._percent
        has = np.zeros(universe + 1, np.int32)
        has[probe] = 1
        # Tokens of the probe up to and including each one of the common order.
        upto = np.cumsum(has)
        stack = [(self._root, 0)]
        while stack:
            node, overlap = stack.pop()
            run, rest, least, largest, lo, hi, _ = node
            if percent * least > 100 * size or percent * size > 100 * largest:
                continue
            own = forest.find(home)
            if all(forest.find(h) == own for h in self.homes[lo:hi]):
                continue
            left = len(probe)
            if len(run):
                overlap += int(has[run].sum())
                left -= int(upto[run[-1]])
            if overlap + min(rest, left) < needed(size, least, percent):
                continue
            ends, below = self._children(node)
            for i in ends:
                if 100 * overlap >= percent * (size + self.sizes[i] - overlap) and forest.joins(home, self.homes[i]):
                    yield self.homes[i]
            stack += [(child, overlap) for child in below]


_MEETING = ["node", "low", "high"]
_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _columns(members: list[dict]) -> tuple[list[np.ndarray], int]:
    """The members' sets as places in the common order of their tokens, frequent ones first."""
    tokens = [_u(m["tokens"], np.uint64) for m in members]
    values, first, place = np.unique(np.concatenate(tokens), return_index=True, return_inverse=True)
    counts = np.concatenate([_u(m["counts"], np.int64) for m in members])[first]
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ranked = rank[place]
    bounds = np.cumsum([0, *map(len, tokens)])
    return [np.sort(ranked[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], len(values)


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the homes of rows (node, low, high, side, home, n_shingles, tokens, counts): the members of side
    1 are looked up by those of side 0, or the latter by each other if there are no more."""

    def linked(probes: list[dict], members: list[dict], forest: Forest) -> list[tuple[int, int]]:
        sets, universe = _columns(probes + members)
        inside = members or probes
        trie = Trie(sets[-len(inside) :], [m["n_shingles"] for m in inside], [m["home"] for m in inside], percent)
        return [(p["home"], other) for p, own in zip(probes, sets, strict=False) for other in trie.join(own, p["n_shingles"], p["home"], universe, forest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, probes, members, streamed, forest, found = None, [], [], False, Forest(), []
        for batch in batches:
            for part in slices(batch, "tokens"):
                for row in part.to_pylist():
                    key = [row[k] for k in _MEETING]
                    if key != meeting:
                        if members or (len(probes) > 1 and not streamed):
                            found += linked(probes, members, forest)
                        meeting, probes, members, streamed, forest = key, [], [], False, Forest()
                    elif len(members) == NODE:
                        found += linked(probes, members, forest)
                        members, streamed = [], True
                    (members if row["side"] else probes).append(row)
                yield _records(_LINKS, {"a": [a for a, _ in found], "b": [b for _, b in found]})
                found = []
        if members or (len(probes) > 1 and not streamed):
            found += linked(probes, members, forest)
        yield _records(_LINKS, {"a": [a for a, _ in found], "b": [b for _, b in found]})

    spread = rows.repartition(shuffle_width(rows), *_MEETING).sortWithinPartitions(*_MEETING, "side")
    return spread.mapInArrow(run, _LINKS)


def _leads(classes: DataFrame, percent: int) -> DataFrame:
    """(token, class, n_shingles) for the rarest tokens of every class, as many as a link could do without and one."""
    schema = T.StructType([T.StructField(name, T.LongType()) for name in ("token", "class", "n_shingles")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tokens"):
                sizes = part.column("n_shingles").to_numpy()
                leads = []
                for data, n in zip(part.column("tokens").to_pylist(), sizes.tolist(), strict=True):
                    tokens = _u(data, np.int64)
                    leads.append(tokens[: len(tokens) - least_overlap(n, percent) + 1])
                lengths = [len(x) for x in leads]
                columns = np.concatenate(leads), np.repeat(part.column("class").to_numpy(), lengths), np.repeat(sizes, lengths)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=to_arrow_schema(schema))

    return classes.select("class", "n_shingles", "tokens").mapInArrow(run, schema)


def _fits(n: str, m: str, percent: int):
    return percent * F.greatest(n, m) <= 100 * F.least(n, m)


def _with_homes(leads: DataFrame, homes: DataFrame | None) -> DataFrame:
    if homes is None:
        return leads.withColumn("home", F.col("class"))
    return leads.join(homes, "class", "left").withColumn("home", F.coalesce("home", "class"))


def _open(leads: DataFrame, *also) -> DataFrame:
    """Groups whose classes are not all in one component."""
    spread = [F.count(F.lit(1)).alias("size"), F.min("home").alias("one"), F.max("home").alias("other")]
    return leads.groupBy("token").agg(*spread, *also).filter("one <> other").drop("one", "other")


def _pivot_meetings(leads: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every class of an open group with the group's pivot of this turn: (node, low, high, side, class, home)."""
    own = F.struct(F.col("class").alias("pivot"), F.col("n_shingles").alias("m"), F.col("home").alias("at"))
    pivots = _open(leads, F.min_by(own, F.xxhash64("class", F.lit(turn))).alias("p")).select("token", "p.*")
    pairs = leads.join(pivots, "token").filter((F.col("home") != F.col("at")) & _fits("n_shingles", "m", percent))
    pairs = stored(pairs.select("class", "home", "pivot", "at").distinct(), "pairs")
    slots = pairs.groupBy("pivot", "at").agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("long").alias("slots"))
    slot = F.pmod(F.xxhash64("class"), F.col("slots"))
    members = pairs.join(slots, ["pivot", "at"]).select(F.col("pivot").alias("node"), slot.alias("low"), F.lit(1).alias("side"), "class", "home")
    probes = slots.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("low"), F.lit(0).alias("side"), F.col("pivot").alias("class"), F.col("at").alias("home"))
    return members.unionByName(probes).withColumn("high", F.lit(0).cast("long"))


def _whole_meetings(leads: DataFrame) -> DataFrame:
    """All classes of the groups that are still open, equal groups once, in blocks of which every two meet."""
    equal = [F.bit_xor(F.xxhash64("class", F.lit(seed))).alias(f"members{seed}") for seed in (1, 2)]
    # A group of two met whole when it met its pivot.
    groups = _open(leads, *equal).filter("size > 2").groupBy("size", "members1", "members2").agg(F.min("token").alias("token"))
    members = leads.join(groups.select("token", F.ceil(F.col("size") / NODE).cast("long").alias("blocks")), "token")
    members = members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return members.select(F.col("token").alias("node"), low.alias("low"), high.alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "class", "home")


def _joined(homes: DataFrame | None, links: DataFrame) -> DataFrame:
    """(class, home) after links between homes: the component of each class that has one."""
    roots = components(links)
    if homes is None:
        return stored(roots.select(F.col("node").alias("class"), F.col("component").alias("home")), "homes")
    moved = homes.join(roots.withColumnRenamed("node", "home"), "home", "left").select("class", F.coalesce("component", "home").alias("home"))
    fresh = roots.join(homes, F.col("node") == F.col("class"), "left_anti").select(F.col("node").alias("class"), F.col("component").alias("home"))
    return stored(moved.unionByName(fresh), "homes")


def linked_classes(classes: DataFrame, percent: int) -> DataFrame | None:
    """(class, home) for the classes (class, n_shingles, tokens, counts) that have links; home is the component."""
    leads, homes = stored(_leads(classes, percent), "leads"), None
    sets = classes.select("class", "n_shingles", "tokens", "counts")
    for turn in range(PIVOTS + 1):
        placed = _with_homes(leads, homes)
        meetings = _pivot_meetings(placed, turn, percent) if turn < PIVOTS else _whole_meetings(placed)
        links = stored(_met(meetings.join(sets, "class"), percent), "links")
        homes = _joined(homes, links)
    return homes


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id."""
    found = shared_sets(docs, width, percent)
    rows = found.filter("tokens IS NULL").select("doc_id", "n_shingles", "digest")
    classes = found.filter("tokens IS NOT NULL").groupBy("digest").agg(F.any_value(F.struct("n_shingles", "tokens", "counts")).alias("s"))
    classes = stored(classes.select("digest", "s.*").withColumn("class", F.monotonically_increasing_id()), "classes")
    homes = linked_classes(classes, percent)
    least = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    least = least.join(classes.select("digest", "class"), "digest", "left").join(homes, "class", "left")
    of_home = least.filter("home IS NOT NULL").groupBy("home").agg(F.min("least").alias("least_of_home"))
    least = least.join(of_home, "home", "left").select("digest", F.when(F.col("home").isNull(), F.col("least")).otherwise(F.col("least_of_home")).alias("component_id"))
    full = rows.filter("digest IS NOT NULL").join(least, "digest").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
