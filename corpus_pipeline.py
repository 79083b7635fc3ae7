"""Corpus pipeline: raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, which are written as Parquet and
read again for the next one. All stages keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillweave.llm import decontam, langid, line_dedup, mixing, near_copies
from tillweave.llm.common import materialize, small_batches

#: Near copies: a Jaccard similarity of 0.8 or more on distinct five-word shingles.
NEAR_COPIES = {"width": 5, "similarity": 0.8}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a labelled language, as the network sees it; texts in none, null or without a letter go."""
    small_batches(spark)
    return langid.documents_in_a_language(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share."""
    small_batches(spark)
    return line_dedup.documents_without_shared_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    small_batches(spark)
    return near_copies.one_per_group(docs, **NEAR_COPIES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontam.documents_without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares by source, language and topic are the flattened ones."""
    return mixing.sample_to_targets(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: The first stage is a trained network, so SQL can't express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
