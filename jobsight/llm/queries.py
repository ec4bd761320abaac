"""The registered query of each operator, over its whole table, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobsight.llm import collocations, digest, direct_codes, filter_audit, language, near_dup, packing, piece_bpe, prefix_trie, sharding, token_counts, top_k, toxicity
from jobsight.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, table: str, sql: str | None = None):
    def register(fn: Callable[[DataFrame, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(like: DataFrame, sf_dir: str, name: str) -> DataFrame:
    return like.sparkSession.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_byte_bpe", "documents")
def _op1(docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip(docs)


@_query("op2_chosen_path", "documents")
def _op2(docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(docs, 3, 85)


@_query("op3_noisy_channel", "documents")
def _op3(docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.predictions(docs, _table(docs, sf_dir, "labels"))


@_query("op4_cross_parsing", "documents")
def _op4(docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.predictions(docs)


@_query("op5_jump_shards", "documents")
def _op5(docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = sharding.shard(docs.select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@_query("op6_best_fit_packing", "documents")
def _op6(docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


@_query("op7_improbable_features", "documents")
def _op7(docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest.compared(docs)


@_query("op8_direct_codes", "documents")
def _op8(docs: DataFrame, sf_dir: str) -> DataFrame:
    return direct_codes.stored_digests(docs)


@_query("op9_token_counts", "documents")
def _op9(docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(docs)


_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


@_query("op10_exact_top_k", "embeddings", _TOP_K)
def _op10(vectors: DataFrame, sf_dir: str) -> DataFrame:
    return top_k.top_k(vectors)


_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY 1),
placed AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words),
followed AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)),
runs AS (
  SELECT lang, [w1] AS p, count(*) AS f FROM followed GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM followed WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM followed WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM followed WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30
),
f AS MATERIALIZED (SELECT lang, array_to_string(p, ' ') AS phrase, p, f FROM runs),
parts AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k, array_to_string(p[1:k], ' ') AS head, array_to_string(p[k + 1:len(p)], ' ') AS tail
  FROM f, range(1, 4) t(k) WHERE len(p) > k
),
heads AS MATERIALIZED (SELECT c.*, x.f AS l FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head),
cuts AS (
  SELECT c.lang, c.phrase, a, k, l, y.f AS r, CAST(2000000::HUGEINT * a // (l + y.f) AS BIGINT) AS score
  FROM heads c JOIN f y ON y.lang = c.lang AND y.phrase = c.tail
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(p[i:i + k - 1], ' ') AS phrase, max(f) AS longest
  FROM f, range(1, 4) s(i), range(2, 4) t(k) WHERE k < len(p) AND i + k - 1 <= len(p) GROUP BY 1, 2
),
kept AS (
  SELECT b.lang, b.phrase, a, l, r, score
  FROM best b LEFT JOIN inside s ON s.lang = b.lang AND s.phrase = b.phrase WHERE longest IS NULL OR 100 * longest < 80 * a
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@_query("op11_collocations", "documents", _PHRASES)
def _op11(docs: DataFrame, sf_dir: str) -> DataFrame:
    return collocations.collocations(docs)


_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s
  FROM words
),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reached AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM sets LEFT JOIN least USING (doc_id)
"""


@_query("op12_prefix_trie", "documents", _JACCARD)
def _op12(docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_trie.jaccard_components(docs)


_AUDIT = r"""
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
texts AS (
  SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM documents d LEFT JOIN marks m USING (doc_id)
),
judged AS (
  SELECT part, good, toxic, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copied
  FROM texts
),
fails AS (
  SELECT part, good, toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN copied THEN 'E' ELSE '' END AS failed,
    count(*) AS n
  FROM judged GROUP BY ALL
),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f) JOIN letters d ON d.f NOT IN (a.f, b.f, c.f)
  JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, '[' || filter_order[1:step - 1] || '_]' AS earlier, '[' || filter_order[1:step] || ']' AS until
  FROM orders, range(1, 6) r(step)
),
counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT regexp_matches(failed, until) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, f) AND NOT regexp_matches(failed, earlier) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, f) AND regexp_matches(failed, earlier) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, f) AND NOT regexp_matches(failed, earlier) THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, f) AND NOT regexp_matches(failed, earlier) THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM fails, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


@_query("op13_filter_audit", "documents", _AUDIT)
def _op13(docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_audit.audit(docs, _table(docs, sf_dir, "labels"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
