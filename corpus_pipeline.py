"""From raw documents to packed training sequences: toxicity, language, near-duplicates, packing.

Every stage works on all rows that the one before kept, and its decisions take effect. All but the last return the
columns of their input, whatever these are. Null and empty texts are not toxic, have no language and leave at the second
stage; repeated rows and copies leave at the third; a table without rows stays without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsight.llm import language, near_dup, packing, toxicity
from jobsight.session import prepare, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-channel score does not call toxic."""
    prepare(spark)
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages; those without a letter are in none."""
    prepare(spark)
    return language.identified(docs, language.learned(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    prepare(spark)
    return near_dup.one_per_group(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Viterbi decoding, suffix automata and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
