"""A training corpus from the documents table: toxicity, exact and near duplicates, source mixing, tokens.

Each stage works on all that the one before kept, which is written as Parquet and read again. All but the last return
the columns of documents: the first three drop rows, the mix drops or repeats rows as its targets ask.

Defined cases: a null text counts as empty, is clean, a copy of every other empty text (the one with the smallest id stays)
and never taken by the mix; null ids rank last among copies; a null source is a source of its own; repeated rows are copies; very long
texts are read whole; an empty table gives an empty result; columns beyond those of documents pass through every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafquarry.llm import bpe, exact_dedup, mixing, simhash, toxicity
from leafquarry.llm.common import new_folder, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs, exact_dedup.DigestIndex(spark, new_folder(spark, "digest-index")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digested(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("bpe", tokens),
]

#: SQL can express neither the classifier nor the fingerprints; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
