"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed level by level. On each level runs of an equal symbol become one symbol;
deterministic coin tossing (the lowest bit in which a symbol differs from its left neighbour, and that
bit, repeated until few labels are left) then marks local maxima, where phrases begin; a phrase is
named by a hash of its symbols. Where a phrase begins depends on a few neighbours only, so equal
substrings have equal phrases but near their ends, whatever their offset. A fingerprint holds minima of
the phrase names of ``LEVELS`` in ``BINS`` bins, and the likeness of two is the share of bins that agree.

Defined cases: a null text is empty; an empty text has a fingerprint of empty bins, like only to
itself and to other texts without a phrase; texts shorter than a phrase are one phrase; documents are
in order of (doc_id, text), null first, so ties and repeated rows follow one another; the last is
followed by the first, a single document by itself; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, small_batches
from tidemark.llm.textvec import RangeHash, seeded, splitmix

#: Levels whose phrase names are sampled; a phrase of level k spans about 3^k bytes.
LEVELS = (2, 3, 4)
BINS = 128
#: Bytes that one pass parses, unless a text is longer.
CHUNK_BYTES = 1 << 19
#: Rows of a range of doc_ids, about.
RANGE_ROWS = 2000
#: Ranges at most; beyond that they hold more rows.
MOST_RANGES = 20_000

_CODES = seeded(256, 41)


def _toss_table(size: int) -> np.ndarray:
    """2 l + (bit l of x) for the lowest bit l in which x differs from y, by x * size + y."""
    x, y = np.divmod(np.arange(size * size), size)
    low = np.zeros(size * size, np.int64)
    differ = x ^ y
    some = differ > 0
    low[some] = np.log2(differ[some] & -differ[some]).astype(np.int64)
    return (2 * low + ((x >> low) & 1)).astype(np.uint8)


_TOSS_8 = _toss_table(256)


def _tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols of which neighbours differ; ``first`` holds where texts begin."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = ~symbols[first]
    differ = symbols ^ before
    lowest = differ & (~differ + np.uint64(1))
    bit = np.frexp(lowest.astype(np.float64))[1] - 1
    label = (2 * bit + ((symbols & lowest) != 0)).astype(np.uint8)
    # 128 labels become 14, then 8, then 6.
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS_8[label.astype(np.int32) * 256 + before]
    return label


def parse(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of every text, and their offsets."""
    n = len(symbols)
    if not n:
        return symbols, off
    edge = np.zeros(n, bool)
    edge[off[:-1][np.diff(off) > 0]] = True
    new = edge.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n)).astype(np.uint64)
    symbol = symbols[at]
    first = np.flatnonzero(edge[at])
    label = _tossed(symbol, first)
    begin = np.zeros(len(at), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    # A phrase of one symbol at a text's end would hang on what follows it elsewhere; the ends stay whole.
    begin[first] = True
    last = np.append(first[1:], len(at)) - 1
    begin[last[last > first]] = False
    follows = first + 1
    begin[follows[follows <= last]] = False
    begin[first] = True
    head = np.flatnonzero(begin)
    named = np.where(length > 1, splitmix(symbol + length * np.uint64(0x9E3779B97F4A7C15)), symbol)
    names = RangeHash(named)(head, np.append(head[1:], len(at)))
    return names, np.searchsorted(at[head], off, "left").astype(np.int64)


def minima(texts: list[bytes]) -> np.ndarray:
    """(texts, BINS) minima of the sampled levels' names; the highest word in an empty bin."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    symbols, at = _CODES[data], off
    out = np.full(len(texts) * BINS, np.iinfo(np.uint64).max, np.uint64)
    for level in range(1, max(LEVELS) + 1):
        symbols, at = parse(symbols, at)
        if level in LEVELS:
            names = splitmix(symbols + np.uint64(level))
            owner = np.repeat(np.arange(len(texts)), np.diff(at))
            cell = owner * BINS + (names >> np.uint64(57)).astype(np.int64)
            order = np.lexsort((names, cell))
            cell, names = cell[order], names[order]
            lead = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
            out[cell[lead]] = np.minimum(out[cell[lead]], names[lead])
    return out.reshape(len(texts), BINS)


def fingerprints(texts: list[str]) -> list[str]:
    """Hexadecimal fingerprints: 16 bits of each bin's minimum, 0000 in an empty bin."""
    out: list[str] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        low = minima(held)
        bits = (low & np.uint64(0xFFFF)).astype(np.uint16)
        bits = np.where(low == np.iinfo(np.uint64).max, 0, np.maximum(bits, 1)).astype(">u2")
        out.extend(row.tobytes().hex() for row in bits)
        held.clear()

    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            flush()
            size = 0
    if held:
        flush()
    return out


def likeness(a: str, b: str) -> float:
    """Share of the bins, of those that either fills, in which two fingerprints agree; 1 if both are empty."""
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    filled = (x > 0) | (y > 0)
    return float(((x == y) & filled).sum() / filled.sum()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first, or all of them."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _ranges(docs: DataFrame) -> list[int | None]:
    """Lowest doc_id of each range of documents: approximate quantiles, as many as ``RANGE_ROWS`` asks for."""
    n = docs.count()
    parts = min(MOST_RANGES, max(1, round(n / RANGE_ROWS)))
    cuts = docs.selectExpr(f"percentile_approx(doc_id, array({', '.join(str(k / parts) for k in range(1, parts))}), {max(1000, 20 * parts)})").head()[0] if parts > 1 else None
    return sorted(set(cuts or []))


def fingerprint_frame(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edit by the next one. One shuffle by ranges of doc_id.

    The first document of each range is sent to the range before as well, where it ends the last pair.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = np.array(_ranges(docs.where("doc_id is not null")), np.int64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        inside = np.searchsorted(cuts, doc_id.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(doc_id.isna(), 0, inside).astype(np.int32))

    ranged = docs.withColumn("part", range_of("doc_id"))
    heads = [(r["part"], r["head"]) for r in ranged.groupBy("part").agg(F.min(F.struct("doc_id")).alias("head")).orderBy("part").collect()]
    # One row for each range: as many as partitions, so they are literals. The head itself is the least text of that doc_id.
    before = {part: heads[k - 1][0] for k, (part, _) in enumerate(heads)}
    head_rows = spark.createDataFrame([(part, head["doc_id"], before[part]) for part, head in heads], "part int, head long, sent int")
    marked = ranged.join(F.broadcast(head_rows), "part")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("copy")), F.struct(F.col("sent").alias("to"), F.lit(True).alias("copy"))))
    sent = marked.withColumn("way", F.explode(F.coalesce(copies, F.array(F.struct(F.col("part").alias("to"), F.lit(False).alias("copy")))))).select("doc_id", "text", "way.to", "way.copy")
    dealt = sent.repartition(max(1, len(heads)), "to").sortWithinPartitions("to", "copy", "doc_id", "text")
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, fingerprint) of a document that waits for the next one

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("to", "copy", "doc_id", "text")), strict=True))
            prints = fingerprints([r[3] for r in rows])
            pairs = []
            for (to, copy, doc_id, text), mark in zip(rows, prints, strict=True):
                if last is not None and last[0] == to:
                    pairs.append((*last[1:], text, mark))
                # The copies of the next range's head sort last; the first of them ends this range.
                last = None if copy else (to, doc_id, text, mark)
            if not pairs:
                continue
            changed = [edited(text, following) for _, text, _, following, _ in pairs]
            marks = fingerprints(changed)
            out = [
                (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark))
                for (doc_id, text, mark, _, next_mark), new, new_mark in zip(pairs, changed, marks, strict=True)
            ]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_frame(documents(spark, sf_dir))
