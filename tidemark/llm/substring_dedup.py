"""Substring deduplication over sliding sentence spans.

Every run of ``SPAN`` consecutive sentences is hashed. Runs are grouped over the whole corpus; a run
met more than once belongs to its first place (lowest doc_id, text and position), and sentences that
any later occurrence covers are removed. A sentence of more than ``PIECE_WORDS`` words counts as
several, so that long passages of few sentences are spans too. It is cut before the last least word
hash of every ``CUT_WINDOW`` of its words: the cuts of a passage are the same whatever stands before
it, no piece is longer than the window, and of 51 words in one sentence at least three pieces lie whole
within. Runs of fewer than ``LEAST_WORDS`` words are too little to mean anything: a run takes as many
sentences as it needs for them, and for ``PIECE_WORDS`` words if it has pieces of a cut one.

Defined cases: a null text stays null, an empty one empty; texts of fewer sentences than a span keep
all; a run repeated inside one text goes after its first place; rows that repeat a whole (doc_id,
text) pair are one document and all keep what the first keeps; null doc_ids come first; extra columns
pass through or are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialise, small_batches, unused
from tidemark.llm.textvec import RangeHash, Words, chunks, int64, owners

SPAN = 3
PIECE_WORDS = 16
CUT_WINDOW = 8
LEAST_WORDS = 10

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _least(hashes: np.ndarray, head: np.ndarray, long: np.ndarray, window: int = CUT_WINDOW) -> np.ndarray:
    """The last least hash of every window of words that lies in one long sentence; ``head`` is each word's sentence."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, window):
        lower = hashes[k : k + n] <= least
        least[lower] = hashes[k : k + n][lower]
        at[lower] = np.flatnonzero(lower) + k
    return at[long[:n] & (head[:n] == head[window - 1 :])]


class Sentences:
    """Sentence pieces of a chunk of texts: byte ranges that together cover every text, with hashes of their words.

    A sentence ends after a full stop, exclamation or question mark that white space follows, or after a
    line end. A range holds all bytes up to the next one. ``words`` has each piece's number of words, ``cut``
    whether its sentence was cut.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, piece_words: int = PIECE_WORDS):
        words = Words(data, off)
        ends = data == 0x0A
        ends[:-1] |= _STOP[data[:-1]] & _BLANK[data[1:]]
        # The sentence of each word: how many ends lie before it in the batch. Texts part in ``owner``.
        sentence = np.cumsum(ends)[words.starts] - ends[words.starts]
        owner = owners(words.off)
        n = len(sentence)
        new = np.ones(n, bool)
        new[1:] = (sentence[1:] != sentence[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        many = np.diff(np.append(head, n))
        long = np.repeat(many > piece_words, many)
        new[_least(words.hashes, np.repeat(head, many), long)] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], n)
        self.cut = long[first]
        self.words = last - first
        self.hashes = RangeHash(words.hashes)(first, last)
        self.off = np.searchsorted(owner[first], np.arange(len(off)), "left").astype(np.int64)
        # A piece begins at its first word, the first of a text at the text's start; it ends where the next begins.
        self.starts = words.starts[first]
        self.ends = np.append(self.starts[1:], len(data)) if n else np.zeros(0, np.int64)
        some = np.diff(self.off) > 0
        self.starts[self.off[:-1][some]] = off[:-1][some]
        self.ends[self.off[1:][some] - 1] = off[1:][some]

    def runs(self, size: int = SPAN, least_words: int = LEAST_WORDS, least_cut: int = PIECE_WORDS) -> np.ndarray:
        """The end of the run that begins at each piece, 0 where none does."""
        n = len(self.words)
        total, cuts = np.append(0, np.cumsum(self.words)), np.append(0, np.cumsum(self.cut))
        at, limit = np.arange(n), np.repeat(self.off[1:], np.diff(self.off))
        end = np.maximum(at + size, np.searchsorted(total, total[at] + least_words, "left"))
        some = cuts[np.minimum(end, n)] > cuts[at]
        end = np.where(some, np.maximum(end, np.searchsorted(total, total[at] + least_cut, "left")), end)
        return np.where(end <= limit, end, 0)

    def spans(self, size: int = SPAN, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text number, position in the text) of every run of ``size`` pieces or, for its words, more."""
        end = self.runs(size, least_words)
        at = np.flatnonzero(end)
        owner = owners(self.off)[at]
        return RangeHash(self.hashes)(at, end[at]), owner, at - self.off[owner]


def spans(docs: DataFrame, size: int = SPAN) -> DataFrame:
    """span, doc, version and place of every run; version tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, version = batch.column("doc"), batch.column("version")
            for first, _, data, off in chunks(batch.column("text")):
                span, owner, place = Sentences(data, off).spans(size)
                rows = pa.array(owner + first)
                yield pa.record_batch({"span": int64(span), "doc": doc.take(rows), "version": version.take(rows), "place": pa.array(place.astype(np.int32))})

    named = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), "text")
    return named.mapInArrow(run, "span long, doc long, version long, place int")


def covered(docs: DataFrame, size: int = SPAN) -> DataFrame:
    """doc, version and places: where non-first occurrences of repeated runs begin, for the documents that have any."""
    found = spans(docs, size)
    # The first shuffle holds hashes only; places follow for the repeated ones. Both lists of spans are written before
    # they are joined: only a join of two plain shuffles has its hot keys split at run time.
    repeated = materialise(found.groupBy("span").agg(F.count("*").alias("times")).where("times > 1").select("span"), "repeated")
    met = materialise(found.join(repeated.hint("merge"), "span"), "spans", repeated)
    first = materialise(met.groupBy("span").agg(F.min(F.struct("doc", "version", "place")).alias("first")), "firsts")
    later = met.join(first.hint("merge"), "span").where(~F.struct("doc", "version", "place").eqNullSafe(F.col("first")))
    # A document's places are no more than its sentences; rows that repeat a document bring the same ones.
    return later.groupBy("doc", "version").agg(F.collect_set("place").alias("places"))


def clean_column(texts: pa.Array, places: pa.Array, size: int = SPAN) -> tuple[list[str | None], list[int], list[int], list[int]]:
    """The texts without the pieces that runs at ``places`` cover; pieces, removed pieces and removed words of each."""
    clean: list[str | None] = []
    pieces, removed, words = [], [], []
    gone, null = places.to_pylist(), texts.is_null().to_pylist()
    for first, end, data, off in chunks(texts):
        s = Sentences(data, off)
        ends = s.runs(size)
        for i in range(end - first):
            a, b = s.off[i], s.off[i + 1]
            drop = np.zeros(b - a, bool)
            if gone[first + i] is not None:
                at = np.asarray(gone[first + i], np.int64)
                edge = np.zeros(b - a + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, ends[a + at] - a, -1)
                drop = np.cumsum(edge)[:-1] > 0
            if null[first + i]:
                clean.append(None)
            elif not drop.any():
                clean.append(data[off[i] : off[i + 1]].tobytes().decode("utf-8"))
            else:
                clean.append(b"".join(data[s.starts[k] : s.ends[k]].tobytes() for k in range(a, b) if not drop[k - a]).decode("utf-8"))
            pieces.append(int(b - a))
            removed.append(int(drop.sum()))
            words.append(int(s.words[a:b][drop].sum()))
    return clean, pieces, removed, words


def dedup_substrings(docs: DataFrame, report: bool = False, size: int = SPAN) -> DataFrame:
    """``docs`` with cleaned texts and all their columns as they were; with ``report`` three counts besides,
    n_sentences, n_removed and n_removed_words, with an underscore before a name that ``docs`` has already.

    A text of which nothing with a word is left becomes empty.
    """
    small_batches(docs.sparkSession)
    doc, version, places, key = unused(docs, "span_doc", "span_version", "span_places", "span_key")
    hits = covered(docs, size).select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("places").alias(places))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    met = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits[doc]) & (keyed[key] == hits[version]), "left").select(*docs.columns, places)
    at = docs.columns.index("text")
    counts = unused(docs, "n_sentences", "n_removed", "n_removed_words")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, pieces, removed, words = clean_column(batch.column(at), batch.column(len(batch.columns) - 1), size)
            columns = [pa.array(clean, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            names = list(batch.schema.names[:-1])
            if report:
                columns += [pa.array(x, pa.int32()) for x in (pieces, removed, words)]
                names += counts
            yield pa.record_batch(columns, names=names)

    return met.mapInArrow(run, schema + ("".join(f", `{c}` int" for c in counts) if report else ""))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir), report=True)
