"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and reads
it back. All stages but the last return the columns of documents. Stage results are defined by their operators: null
texts count as empty, repeated rows are rows of their own, an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import jaccard_join, mixing, packing, quality_knn, secret_ledger
from hushframe.llm.common import drop, materialize, scratch

#: Shares of expected tokens; those of low and toxic text are upper bounds: it is thinned out, never raised. Clean tokens stay.
TARGETS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_knn.keep_good(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles stays."""
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secret_ledger.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the rates say that meet the target weights."""
    return mixing.repeat_by_rate(docs, _labels(spark, sf_dir), TARGETS, thin=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: A classifier and tokens aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # a stage's own tables go when its result is written, and its input with them
            docs = keep(materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
