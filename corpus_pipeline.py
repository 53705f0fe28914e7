"""Corpus pipeline over ``documents``: five stages, each on all that the one before has kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last adds
the sizes of the mix and returns the documents that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions.storage import discard, stash
from loomgraph.llm import decontam, mixing, ngram_join, substrings, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. It learns from the labels of the rows at hand."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similar ones."""
    return ngram_join.deduplicated(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages of 50 words or more that a document with a smaller id has too."""
    return substrings.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]
#: A trained classifier, MinHash and edit distances are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        if old is not None:
            discard(old)
        old = docs
    return docs
