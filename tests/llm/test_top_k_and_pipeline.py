"""Exact top-k against all pairs, components against union-find, and the pipeline end to end."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobsight.llm import components, language, near_dup, top_k, toxicity

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, rank STRING, v STRING"


def brute(rows, k, every):
    table = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows}
    out = []
    for q in table:
        if q % every == 0:
            best = sorted((-int(table[q] @ table[c]), c) for c in table if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bits", [3, 9, 20])
def test_top_k_is_that_of_all_pairs(spark, bits):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 12).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    odd = [(1000, None), (1001, [None] * 12), (1100, [float("nan")] + [0.0] * 11), (1200, [float("inf")] + [0.0] * 11)]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd], VECTORS)
    got = sorted(map(tuple, top_k.top_k(table, 5, 20, block_rows=64, query_rows=7, bits=bits).collect()))
    assert got == brute(rows, 5, 20)


def test_top_k_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0], None, None), (3, [2.0], None, None), (100, [-1.0, 5.0], None, None)], VECTORS)
    got = sorted(map(tuple, top_k.top_k(table).collect()))
    assert got == [(0, 1, 3, 2 << 20), (0, 2, 100, -(1 << 20)), (100, 1, 0, -(1 << 20)), (100, 2, 3, -(2 << 20))]
    assert top_k.top_k(table.limit(0)).count() == 0


def test_top_k_of_repeated_query_ids(spark):
    rows = [(0, [1.0]), (0, [1.0]), (0, [-1.0]), (1, [0.9]), (2, [0.8]), (3, [0.7]), (3, [0.75])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    score = lambda a, b: int(np.floor(1024 * a)) * int(np.floor(1024 * np.float32(b).astype(float)))
    others = [(i, v[0]) for i, v in rows if i]
    want = []
    for q in (1.0, 1.0, -1.0):
        best = sorted((-score(q, v), i) for i, v in others)[:3]
        want += [(0, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert sorted(map(tuple, top_k.top_k(table, k=3, block_rows=2, query_rows=1).collect())) == sorted(want)


def test_components_of_random_links(spark):
    rng = np.random.default_rng(2)
    links = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(250)] + [(0, i) for i in range(500, 700)] + [(i, i + 1) for i in range(800, 830)]
    forest = components.Forest()
    for a, b in links:
        forest.joins(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert got == {x: forest.find(x) for a, b in links if a != b for x in (a, b)}


def test_pipeline_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs.withColumns({"score": F.lit("mine"), "component": F.lit(1)})
    odd = spark.createDataFrame([(None, None), (10**6, ""), (10**6 + 1, "?? 12")], "doc_id BIGINT, text STRING")
    kept = kept.unionByName(odd, allowMissingColumns=True).unionByName(kept.limit(3))
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == columns
        gone = before.join(kept.select("doc_id"), "doc_id", "left_anti")
        if name == "language":
            assert {r.doc_id for r in gone.select("doc_id").collect()} >= {10**6, 10**6 + 1}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    assert near_dup.near_duplicates(kept).filter("not kept").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert {r.doc_id for r in packed} == set(ids)


def test_pipeline_is_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in toxicity.scored(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    left = docs.filter(~F.col("doc_id").isin(list(bad)))
    left = left.join(language.identify(left.select("doc_id", "text"), language.learned(left)).filter("lang_pred <> 'und'").select("doc_id"), "doc_id")
    want = {r.doc_id for r in near_dup.near_duplicates(left).filter("kept").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == want
    assert max(Counter((r.doc_id, r.piece) for r in rows).values()) == 1
