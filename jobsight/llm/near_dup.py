"""Near-duplicate documents: a chosen-path join of shingle sets, confirmed on the full sets.

1. Every text becomes its set of shingles (64-bit hashes of word runs), a 128-bit digest of the set and a signature of
   minwise tokens. Equal sets are one class from here on, so copies cost one row.
2. Independent trees branch the classes: a node picks one or more signature places by its own hash, 1 / similarity of
   them on average, and sends each class to the child that its token there names. A pair as similar as the threshold
   stays together on some path of a tree with a chance that falls slowly with the depth; ``TREES`` trees make a miss
   unlikely (below 1e-6 at depth 2, 1e-4 at depth 6). Small nodes are compared exhaustively on signatures. A large node
   compares all members with one of them, its pivot. Members very close to the pivot branch no further: by the triangle
   inequality, whatever agrees with them agrees with the pivot nearly as well, and is kept together with it. So a large
   group of copies does not multiply level by level. Nodes that stay large to the last level are kept together whole.
3. What was found so far only says who may be linked. Connected candidates meet once, in blocks of bounded size, and
   are linked on their full sets; every pair of a candidate component is looked at, and only a spanning forest of the
   links leaves a task.
4. Components of the confirmed links.

Null, empty and blank texts have an empty set and are linked with nothing; a text with fewer words than a shingle is one
shingle of all its words. Repeated rows are copies of each other, even with the same doc_id. A null doc_id never is a
component's id unless all its members' are null. Extra columns do not matter; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from jobsight.llm.batches import filled, map_batches, slices
from jobsight.llm.components import Forest, components
from jobsight.llm.ordering import order_key, shuffle_width
from jobsight.session import stored

WORDS, PERCENT = 5, 80
#: Minwise tokens of a signature, trees, levels at which nodes are counted, and the size up to which a node is small.
PLACES, TREES, LEVELS, NODE_LIMIT = 64, 12, (2, 4, 6, 8), 48
#: Members of a large node whose signatures differ from its pivot's in at most so many places branch no further.
CLOSE = 12
#: Candidates that meet in one block; two blocks meet in one task.
BLOCK = 256
#: Signatures agree in at least this many standard deviations below the threshold; confirmed links decide.
DEVIATIONS = 4.5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_MEMO = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = (x + _MIX).astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_FACTORS = mix(np.arange(PLACES, dtype=np.uint64)) | np.uint64(1)


class Shingler:
    """Sets of shingle hashes, sorted."""

    def __init__(self, width: int):
        self._width, self._known = width, {}

    def words(self, text: str) -> np.ndarray:
        known, out = self._known, []
        # Bytes are split at the six ASCII spaces and lower-cased in A-Z only.
        for word in text.encode().lower().split():
            h = known.get(word)
            if h is None:
                h = xxhash.xxh3_64_intdigest(word)
                if len(known) < _WORD_MEMO:
                    known[word] = h
            out.append(h)
        return np.array(out, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        width = min(self._width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = mix(out * _MIX + words[i : i + n])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least 32-bit token of the set under each of ``PLACES`` hash functions."""
    best = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        tokens = (shingles[at : at + 4096, None] * _FACTORS) >> np.uint64(32)
        np.minimum(best, tokens.min(axis=0).astype(np.uint32), out=best)
    return best


def children(nodes: np.ndarray, owners: np.ndarray, signatures: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes for the classes in them: (child, owner) pairs. A node's own hash picks its places."""
    share = 1 / similarity
    whole, extra = int(share), share - int(share)
    found = []
    for k in range(whole + 1):
        pick = mix(nodes ^ np.uint64((k + 1) * 0x51ED2701))
        place = (pick % np.uint64(PLACES)).astype(np.int64)
        chosen = np.ones(len(nodes), bool) if k < whole else (pick >> np.uint64(40)).astype(np.float64) < extra * (1 << 24)
        token = signatures[owners, place].astype(np.uint64)
        child = mix(nodes * _MIX + token * np.uint64(PLACES) + place.astype(np.uint64))
        found.append((child[chosen], owners[chosen]))
    return np.concatenate([c for c, _ in found]), np.concatenate([o for _, o in found])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PLACES)


SIGNED = [
    T.StructField("text_hash", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("digest", T.BinaryType()),
    T.StructField("signature", T.BinaryType()),
]


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Each row's set size, set digest and signature."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *SIGNED])

    def make():
        tool = Shingler(width)

        def work(batch):
            out = {"n_shingles": [], "digest": [], "signature": []}
            for text in filled(batch.column("text")).to_pylist():
                own = tool.shingles(text)
                out["n_shingles"].append(len(own))
                out["digest"].append(xxhash.xxh3_128_digest(own.tobytes()))
                out["signature"].append(signature(own).tobytes())
            return out | {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash")}

        return work

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), make, schema, "text")


_NODES = T.StructType([T.StructField("class", T.LongType()), T.StructField("node", T.LongType())])


def _descend(rows: DataFrame, levels: int, similarity: float) -> DataFrame:
    """(class, node) rows ``levels`` further down, from rows (class, signature) at the roots or (class, signature, node)."""
    at_roots = "node" not in rows.columns

    def make():
        def work(batch):
            signatures = _signatures(batch.column("signature"))
            owners = np.arange(batch.num_rows)
            if at_roots:
                nodes = np.repeat(mix(np.arange(TREES, dtype=np.uint64)), batch.num_rows)
                owners = np.tile(owners, TREES)
            else:
                nodes = batch.column("node").to_numpy().view(np.uint64)
            for _ in range(levels):
                nodes, owners = children(nodes, owners, signatures, similarity)
            return {"class": batch.column("class").to_numpy()[owners], "node": nodes.view(np.int64)}

        return work

    return map_batches(rows, make, _NODES)


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def least_agreement(similarity: float) -> float:
    """Signature places in which two sets of the similarity agree at least, but for a negligible chance."""
    return similarity * PLACES - DEVIATIONS * (similarity * (1 - similarity) * PLACES) ** 0.5


_MET = T.StructType([*_NODES, T.StructField("pivot", T.LongType()), T.StructField("agreement", T.LongType())])


def _met_pivot(large: DataFrame, signatures: DataFrame) -> DataFrame:
    """(class, node, pivot, agreement) for the members (class, node, pivot) of large nodes."""
    pivots = large.select("node", "pivot").distinct().join(signatures.select(F.col("class").alias("pivot"), F.col("signature").alias("theirs")), "pivot")
    rows = large.select("class", "node").join(signatures, "class").join(pivots, "node")

    def make():
        def work(batch):
            agreement = (_signatures(batch.column("signature")) == _signatures(batch.column("theirs"))).sum(axis=1)
            return {name: batch.column(name) for name in ("class", "node", "pivot")} | {"agreement": agreement}

        return work

    return map_batches(rows, make, _MET)


def _edges_of_small(rows: DataFrame, similarity: float) -> DataFrame:
    """Links between classes of one small node whose signatures agree enough; rows come sorted by node."""
    least = least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            for part in slices(batch, None):
                nodes, classes = part.column("node").to_numpy(), part.column("class").to_numpy()
                signatures = _signatures(part.column("signature"))
                if carry is not None:
                    nodes, classes, signatures = (np.concatenate(x) for x in zip(carry, (nodes, classes, signatures), strict=True))
                # A node may go on in the next slice: its rows are looked at again there.
                last = nodes == nodes[-1]
                carry = nodes[last], classes[last], signatures[last]
                a, b = [], []
                for lag in range(1, len(nodes)):
                    same = np.flatnonzero(nodes[lag:] == nodes[:-lag])
                    if not len(same):
                        break
                    close = same[(signatures[same] == signatures[same + lag]).sum(axis=1) >= least]
                    a.append(classes[close])
                    b.append(classes[close + lag])
                forest = Forest()
                kept = [(x, y) for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True) if forest.joins(x, y)] if a else []
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in kept], pa.int64()) for k in (0, 1)], schema=to_arrow_schema(_EDGES))

    return rows.mapInArrow(run, _EDGES)


def candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) between classes that may be similar, by the trees."""
    rows, edges, depth = classes.select("class", "signature"), None, 0
    signatures = rows
    for level in LEVELS:
        placed = stored(_descend(rows, level - depth, similarity), "nodes")
        depth = level
        pivot = F.min_by("class", F.xxhash64("class", "node")).alias("pivot")
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("size"), pivot).filter("size > 1")
        shared = stored(placed.join(sizes, "node"), "nodes")
        small = shared.filter(F.col("size") <= NODE_LIMIT).select("class", "node").join(signatures, "class")
        small = small.repartition(shuffle_width(classes), "node").sortWithinPartitions("node", "class")
        found = _edges_of_small(small, similarity)
        edges = found if edges is None else edges.unionByName(found)
        large = shared.filter(F.col("size") > NODE_LIMIT)
        if not large.take(1):
            return edges
        if level == LEVELS[-1]:
            return edges.unionByName(large.select(F.col("class").alias("a"), F.col("pivot").alias("b")))
        met = stored(_met_pivot(large, signatures), "met")
        near = met.filter(F.col("agreement") >= least_agreement(similarity) - CLOSE)
        edges = edges.unionByName(near.select(F.col("class").alias("a"), F.col("pivot").alias("b")))
        rows = met.filter(F.col("agreement") < PLACES - CLOSE).select("class", "node").join(signatures, "class")


def similar_pairs(sets: list[np.ndarray], percent: int, split: int) -> Iterator[tuple[int, int]]:
    """Index pairs whose sets have 100 * intersection >= percent * union; the first ``split`` sets are not compared with
    each other if ``split`` is positive, nor are the others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    run = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(values)]])))
    shared = np.diff(np.concatenate([starts, [len(values)]])) > 1
    kept = shared[run]
    owner, column = owner[kept], (np.cumsum(shared) - 1)[run[kept]]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = 8192
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        present = np.zeros((len(sets), min(width, int(shared.sum()) - at)), np.float32)
        present[owner[lo:hi], column[lo:hi] - at] = 1
        both += present @ present.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = np.triu(100 * both >= percent * union, 1)
    if split > 0:
        linked[:split, :split] = linked[split:, split:] = False
    yield from zip(*(x.tolist() for x in np.nonzero(linked)), strict=True)


def _confirmed(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between classes, from rows (meeting, class, side, text) sorted by meeting and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Shingler(width)
        meeting, sides, classes, sets = None, [], [], []

        def links():
            forest = Forest()
            split = sides.count(0) if any(sides) else 0
            pairs = ((classes[i], classes[j]) for i, j in similar_pairs(sets, percent, split)) if len(sets) > 1 else ()
            kept = [(x, y) for x, y in pairs if x != y and forest.joins(x, y)]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in kept], pa.int64()) for k in (0, 1)], schema=to_arrow_schema(_EDGES))

        for batch in batches:
            for part in slices(batch, "text"):
                columns = (part.column(n).to_pylist() for n in ("meeting", "side", "class", "text"))
                for m, side, own, text in zip(*columns, strict=True):
                    if m != meeting:
                        if len(sets) > 1:
                            yield links()
                        meeting, sides, classes, sets = m, [], [], []
                    sides.append(side)
                    classes.append(own)
                    sets.append(tool.shingles(text or ""))
        if len(sets) > 1:
            yield links()

    return members.mapInArrow(run, _EDGES)


def confirm(docs: DataFrame, classes: DataFrame, grouped: DataFrame, width: int, percent: int) -> DataFrame:
    """Links confirmed on full sets among the members of each candidate component (node, component)."""
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = grouped.join(sizes, "component").select(F.col("node").alias("class"), "component", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = members.join(classes.select("class", "doc_id", "text_hash"), "class")
    # Members of a large component are dealt into blocks, and every two blocks meet.
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("block", block).withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    members = members.select("class", "doc_id", "text_hash", F.xxhash64("component", low, high).alias("meeting"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    texts = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text")
    met = texts.join(members, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    met = met.select("meeting", "side", "class", "text").dropDuplicates(["meeting", "class"])
    met = met.repartition(shuffle_width(docs), "meeting").sortWithinPartitions("meeting", "side")
    return _confirmed(met, width, percent)


def grouped_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles and group, a number that linked rows share."""
    rows = stored(signed(docs, width).withColumn("row", F.monotonically_increasing_id()), "signed")
    first = F.min_by(F.struct(F.col("row").alias("class"), "doc_id", "text_hash", "signature"), "row")
    classes = rows.filter("n_shingles > 0").groupBy("digest").agg(first.alias("f")).select("digest", "f.*")
    classes = stored(classes, "classes")
    found = stored(components(candidates(classes, percent / 100)), "candidates")
    linked = components(stored(confirm(docs, classes, found, width, percent), "confirmed"))
    full = rows.filter("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "digest").join(classes.select("digest", "class"), "digest")
    full = full.join(linked.withColumnRenamed("node", "class"), "class", "left")
    full = full.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "class").alias("group"))
    empty = rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("row").alias("group"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id and kept."""
    rows = stored(grouped_rows(docs, width, percent), "groups")
    least = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "group").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_per_group(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group, the least by doc_id and then by the hash of its text."""
    # Compared by id (null first) and text hash, which only rows that repeat share.
    kept = grouped_rows(docs, width, percent).groupBy("group").agg(F.min(F.struct(order_key().alias("_id"), F.col("text_hash").alias("_text"))).alias("k"))
    kept = kept.select("k._id", "k._text").distinct()
    keyed = docs.withColumn("_id", order_key()).withColumn("_text", F.xxhash64("text"))
    return keyed.join(kept, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select(*docs.columns)
