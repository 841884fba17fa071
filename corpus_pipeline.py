"""The corpus pipeline: documents to a mixed training corpus in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the
shared folder and read again as the next stage's docs. All stages but the last return the columns of
documents. A stage's operator defines what it does with nulls, empty and very long texts, ties,
repeated rows, empty tables and columns with clashing names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaystone.llm import op01_decontaminate, op02_quality, op03_mixing, op08_secrets, op09_near_dedup
from quaystone.llm.store import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    machine = op02_quality.train(docs, table(spark, sf_dir, "labels"))
    return op02_quality.accepted(docs, machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return op09_near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; passages of the benchmark go from the others."""
    return op01_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return op08_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources more often: with epoch, block and block_rank."""
    return op03_mixing.mix(docs, carry=True)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: SQL can express neither the trained stages nor the graph; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
