"""Shared fixture data of the training-data operators."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """The odd rows with extra columns whose names clash with those that operators make."""
    from fixtures import odd_rows
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in ("size", "shard", "key", "kept", "root", "span", "doc", "fingerprint", "sequence_id", "kept_key")])


@pytest.fixture
def none(odd):
    return odd.limit(0)
