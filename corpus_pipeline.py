"""A training corpus from raw documents: five stages, each an operator of ``tidemark.llm``.

Every stage reads all that its predecessor kept, as Parquet in the shared folder, and its decisions
take effect. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, quality_ordinal, quality_rules, substring_dedup
from tidemark.llm.labelled import labels_of
from tidemark.llm.tokens import vocabulary_path
from tidemark.session import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, labels_of(spark, sf_dir)))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects."""
    return quality_ordinal.keep_selected(docs, quality_ordinal.train(docs, labels_of(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without sentences of repeated spans; n_chars follows the text."""
    return substring_dedup.dedup_substrings(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("packing", pack),
]

#: The fitted models and weighted samples can't be put in SQL; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
