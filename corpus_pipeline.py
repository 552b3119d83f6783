"""documents -> good, distinct, free of personal data, packed into sequences.

Each stage's docstring in its operator's module says what becomes of nulls, empty and very long texts, ties, repeated rows, no rows and other columns' names; every stage
but the last passes all columns on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from studylake.llm import minhash, packing, pii, quality
from studylake.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays. Each stage's documents are files, so they are read as they are."""
    return minhash.keep_one(docs, written=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packed)]

#: SQL has neither the hashes nor the tokenizers of these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
