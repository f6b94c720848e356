"""A corpus clean-up over the documents table, one operator a stage.

Each stage takes what its predecessor kept, decides about it, and hands on the columns of documents; the last adds probability and weight.
Stages are written as Parquet where the caller runs them one by one; run() writes the first four to a workspace in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import mixing, pii, quality_gam
from corvane.llm.decontamination import decontaminated
from corvane.llm.ngram_jaccard import one_of_each
from corvane.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_gam.accepted(docs, quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are 0.8 alike."""
    return one_of_each(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to raked weights of source, language and topic, with probability and weight."""
    return mixing.sampled(docs)


STAGES = [("quality_classifier", quality), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark), ("pii", personal_data), ("mixing", mix)]
#: The classifier and the disguises are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.keep(docs, name)
            space.only(name)  # the stages before have been read
    return docs
