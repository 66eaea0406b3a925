"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from courtlens.llm import op2_toxicity, op3_host_rules, op7_packing, op9_simhash, op10_line_dedup
from courtlens.llm.common import read
from courtlens.llm.queries import vocabulary
from courtlens.session import run_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return op2_toxicity.keep(docs, read(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source does."""
    return op3_host_rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that an earlier place holds; n_chars follows the text."""
    return op10_line_dedup.dedup_lines(docs, length="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return op9_simhash.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return op7_packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]
#: SQL cannot express the classifier, the fingerprints or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
