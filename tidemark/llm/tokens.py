"""Encoding and decoding of whole documents, scored in Arrow batches by :mod:`tidemark.llm.bpe`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe
from tidemark.llm.common import documents

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine has a public vocabulary file; the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every text; null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            ids = [x.tolist() for x in coder.encode(batch.column("text").to_pylist())]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows that :func:`encode` made; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The number of tokens of every text, and SHA-256 of its ids and of the text decoded from them.

    Repeated rows give repeated results, a null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        shown = [str(i) for i in range(coder.size)]
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for ids in coder.encode(batch.column("text").to_pylist()):
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_sha256": pa.array(ids_sha, pa.string()),
                    "decoded_sha256": pa.array(text_sha, pa.string()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary_path())
