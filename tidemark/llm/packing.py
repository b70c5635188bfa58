"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of which exactly k fill a
sequence. A document whose length would leave too much of its class's share empty is cut at the next
reciprocal, and the rest goes on the same way. Every worker fills the bins of each class by itself;
what its last, open bins hold it joins end to end and cuts at the capacity, so a worker leaves one
partly filled sequence at most.

Defined cases: a null or empty text is the end token alone; longer documents than a sequence are
cut; repeated rows are packed each; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe
from tidemark.llm.common import documents, small_batches
from tidemark.llm.tokens import vocabulary_path

CAPACITY = 4096
END_TOKEN = 2
#: Share of a reciprocal that a piece must fill to be kept whole.
LEAST_FILL = 0.98
#: Sequences of one worker are numbered below this; its partition number stands above.
WORKER_SEQUENCES = 1 << 36

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, harmonic_class int"


@cache
def cuts(length: int, capacity: int = CAPACITY, least_fill: float = LEAST_FILL) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a document shorter than a sequence."""
    out = []
    while length:
        k = capacity // length
        if k * length >= least_fill * capacity:
            out.append((length, k))
            break
        out.append((capacity // (k + 1), k + 1))
        length -= capacity // (k + 1)
    return tuple(out)


class Harmonic:
    """The open bins of one worker. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = CAPACITY, least_fill: float = LEAST_FILL, first: int = 0):
        self.capacity, self.least_fill, self.next = capacity, least_fill, first
        self.bins: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple], k: int) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset, k
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of the bins that this document fills."""
        ids = ids.astype("<u4")
        total, start = len(ids), 0
        whole = total // self.capacity
        for length, k in [*[(self.capacity, 1)] * whole, *cuts(total - whole * self.capacity, self.capacity, self.least_fill)]:
            held = self.bins.setdefault(k, [])
            held.append((doc_id, start, ids[start : start + length].copy(), total))
            start += length
            if len(held) == k:
                yield from self._close(self.bins.pop(k), k)

    def finish(self) -> Iterator[tuple]:
        """Rows of what is left, end to end; class 0."""
        held, room = [], self.capacity
        for k in sorted(self.bins):
            for doc_id, start, ids, total in self.bins[k]:
                while len(ids):
                    part = ids[:room]
                    held.append((doc_id, start, part, total))
                    start, ids, room = start + len(part), ids[len(part) :], room - len(part)
                    if not room:
                        yield from self._close(held, 0)
                        held, room = [], self.capacity
        self.bins = {}
        if held:
            yield from self._close(held, 0)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_token: int = END_TOKEN, least_fill: float = LEAST_FILL) -> DataFrame:
    """A row for each piece of each document's tokens, with its sequence and its place there. No shuffle: workers pack what they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        worker = Harmonic(capacity, least_fill, TaskContext.get().partitionId() * WORKER_SEQUENCES)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * (len(names) - 1) + [pa.int32()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist()), strict=True):
                rows.extend(worker.add(doc_id, np.append(ids, np.int32(end_token))))
            if rows:
                yield table(rows)
        if rows := list(worker.finish()):
            yield table(rows)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path())
