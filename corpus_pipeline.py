"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is one operator of ``cuegrid.llm`` applied to everything the stage before it kept. All but
the last return the columns of documents; every stage's result is written as Parquet below the shared
folder of ``spark.checkpoint.dir`` and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuegrid.llm.line_dedup import drop_repeated_lines
from cuegrid.llm.mixing import mix_documents
from cuegrid.llm.near_dedup import drop_near_duplicates
from cuegrid.llm.packing import pack_documents
from cuegrid.llm.quality import good_documents
from cuegrid.scratch import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. The classifier learns from the labelled rows."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line are cut out; every document stays."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, up to three times, so that sources come near their target weights."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in pieces where needed, gets a place in a training sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

#: SQL cannot express the first stage (a fitted classifier) nor the last (greedy packing).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
