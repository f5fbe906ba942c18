"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, in their own columns; the last one
returns a row for each document of the token files. run() writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontam, mixing, neardup, tokenfile, toxicity
from tallyspark.llm.common import crc_mod, stored
from tallyspark.llm.queries import table, tokenizer


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the machine learns from the training folds of the labels."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return toxicity.clean(docs, toxicity.trained(toxicity.training_rows(docs, labels)))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return neardup.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the target marginals of source, language and topic."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written to files; a row for each document in them."""
    return tokenfile.read(*tokenfile.write(docs, tokenizer()))


STAGES = [
    ("toxicity", toxic_out), ("near_duplicates", near_duplicates_out), ("decontamination", benchmark_out),
    ("mixing", mixed), ("token_files", token_files),
]

#: SQL has no tokenizer, no string kernel and no consistent weighted sampling: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
