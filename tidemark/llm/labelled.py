"""Bounded labelled samples and hashed-text features that the two quality models share.

Features of a text are hashed words and word pairs and hashed character trigrams, each counted over the
square root of the text's length, so that a score is a scaled sum of weights and needs no sparse vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table
from tidemark.llm.textvec import Words, byte_codes, chunks, owners, seeded, splitmix

#: Hashed features of each of the two kinds.
WORD_DIM, CHAR_DIM = 1 << 18, 1 << 14
#: Items of weight 0 that a text is thought to have besides its own.
PRIOR_ITEMS = 40
#: Labelled documents that a model is fitted on at most; those with the lowest hash of their doc_id.
SAMPLE_ROWS = 5000
#: A word feature is learnt from if so many sampled texts have it.
LEAST_TEXTS = 10
#: Items of the sample that one sum takes at a time.
ITEMS = 1 << 19
#: A text's features: their numbers, ascending, and their values. However long the text, it has ``WORD_DIM + CHAR_DIM`` at most.
Bag = tuple[np.ndarray, np.ndarray]


def features(data: np.ndarray, off: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(indices, offsets) of the word features and of the character features of each text."""
    words = Words(data, off)
    n = len(words.hashes)
    pair = np.zeros(n, np.uint64)
    last = np.zeros(n, bool)
    last[words.off[1:][np.diff(words.off) > 0] - 1] = True
    inner = np.flatnonzero(~last)
    a, b = seeded(2, 5) | np.uint64(1)
    pair[inner] = splitmix(words.hashes[inner] * a + words.hashes[inner + 1] * b)
    pair[last] = splitmix(words.hashes[last] * a)
    both = np.empty(2 * n, np.int32)
    both[0::2] = (words.hashes >> np.uint64(7)).astype(np.int64) % (WORD_DIM // 2)
    both[1::2] = WORD_DIM // 2 + (pair >> np.uint64(7)).astype(np.int64) % (WORD_DIM // 2)
    codes = byte_codes(data)
    c, d, e = seeded(3, 6) | np.uint64(1)
    tri = codes * c
    tri[:-1] += codes[1:] * d
    tri[:-2] += codes[2:] * e
    chars = (splitmix(tri) >> np.uint64(9)).astype(np.int64) % CHAR_DIM
    keep = np.ones(len(data), bool)
    for back in (1, 2):
        at = off[1:] - back
        keep[at[at >= off[:-1]]] = False
    size = np.maximum(np.diff(off) - 2, 0)
    return (both, 2 * words.off), (chars[keep].astype(np.int32), np.append(0, np.cumsum(size)))


def root_length(off: np.ndarray) -> np.ndarray:
    """What a text's counts are divided by. Chance sums of n weights grow with the root of n, so that a few telling
    words stand out in a long text as well, and a few words alone say little.
    """
    return np.sqrt(np.diff(off) + PRIOR_ITEMS)


def scaled_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.bincount(owners(off), weights=values, minlength=len(off) - 1) / root_length(off)


@dataclass
class Hashed:
    """Weights of the hashed features; ``score`` is the sum of their scaled sums over a text."""

    words: np.ndarray
    chars: np.ndarray
    bias: float = 0.0

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        (w, w_off), (c, c_off) = features(data, off)
        return self.bias + scaled_sums(self.words[w], w_off) + scaled_sums(self.chars[c], c_off)

    def score_column(self, column: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.score(data, off) for _, _, data, off in chunks(column))])


@dataclass
class Sample:
    """A labelled sample as one sparse matrix: item ``i`` of text ``row[i]`` is feature ``features[col[i]]`` with value ``val[i]``."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int
    features: np.ndarray
    mean: np.ndarray | float = 0.0

    @property
    def dim(self) -> int:
        return len(self.features)

    def hashed(self, weights: np.ndarray, bias: float = 0.0) -> Hashed:
        """Weights of the sample's features as weights of all hashed features."""
        full = np.zeros(WORD_DIM + CHAR_DIM)
        full[self.features] = weights
        return Hashed(full[:WORD_DIM].astype(np.float32), full[WORD_DIM:].astype(np.float32), bias)

    def scaled(self) -> np.ndarray:
        """Bring features to a common scale, values of the texts that have one to a root mean square of 1; gives the factors."""
        have, square, total = (np.zeros(self.dim) for _ in range(3))
        for p in self._parts():
            have += np.bincount(self.col[p], minlength=self.dim)
            square += np.bincount(self.col[p], weights=self.val[p] * self.val[p], minlength=self.dim)
        scale = np.sqrt(have / np.maximum(square, 1e-18))
        for p in self._parts():
            self.val[p] *= scale[self.col[p]].astype(np.float32)
            total += np.bincount(self.col[p], weights=self.val[p], minlength=self.dim)
        self.mean = total / max(1, self.n)
        return scale

    def _parts(self) -> Iterator[slice]:
        """Runs of items: sums over all at once would need several more arrays of their size."""
        return (slice(k, k + ITEMS) for k in range(0, len(self.val), ITEMS))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Products with the features less their means: without the means the fit converges far sooner."""
        out = np.zeros(self.n)
        for p in self._parts():
            out += np.bincount(self.row[p], weights=self.val[p] * weights[self.col[p]], minlength=self.n)
        return out - self.mean @ weights

    def times_transposed(self, residual: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim)
        for p in self._parts():
            out += np.bincount(self.col[p], weights=self.val[p] * residual[self.row[p]], minlength=self.dim)
        return out - self.mean * residual.sum()


def bags(texts: pa.Array) -> Iterator[Bag]:
    """The features of every text of a column."""
    dim = np.int64(WORD_DIM + CHAR_DIM)
    for first, end, data, off in chunks(texts):
        parts = []
        for (index, at), shift in zip(features(data, off), (0, WORD_DIM), strict=True):
            key, count = np.unique(owners(at) * dim + index + shift, return_counts=True)
            row = key // dim
            values = (count / root_length(at)[row]).astype(np.float32)
            parts.append(((key % dim).astype(np.int32), values, np.searchsorted(row, np.arange(end - first + 1))))
        for i in range(end - first):
            own = [slice(at[i], at[i + 1]) for _, _, at in parts]
            yield tuple(np.concatenate([part[k][x] for part, x in zip(parts, own, strict=True)]) for k in (0, 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[Bag, int, int]]:
    """(features, quality, toxic) of a bounded sample in a fixed order; the features are made where the texts are.

    Labels without a doc_id or quality don't count; of several labels of one document the lowest
    quality and the highest toxicity hold, of several texts the first in order. A null toxicity is 0.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` rows, so they may always be broadcast.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    one = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").cast("long").alias("quality"), F.first("toxic").cast("long").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(bags(batch.column("text")))
            yield pa.record_batch(
                {c: batch.column(c) for c in ("doc_id", "quality", "toxic")}
                | {name: pa.array([bag[k].tobytes() for bag in found], pa.binary()) for k, name in enumerate(("numbers", "means"))}
            )

    counted = one.mapInArrow(run, "doc_id long, quality long, toxic long, numbers binary, means binary")
    found = [(r["doc_id"], (np.frombuffer(r["numbers"], np.int32), np.frombuffer(r["means"], np.float32)), r["quality"], r["toxic"]) for r in counted.toLocalIterator()]
    return [x[1:] for x in sorted(found, key=lambda x: x[0])]


def sparse(found: list[Bag | str]) -> Sample:
    """The sample's features; word features of too few texts are left out. Plain texts are counted here."""
    texts = [x for x in found if isinstance(x, str)]
    counted = bags(pa.array(texts, pa.string()))
    held = [next(counted) if isinstance(x, str) else x for x in found]
    texts_with = np.zeros(WORD_DIM + CHAR_DIM, np.int64)
    for col, _ in held:
        texts_with[col] += 1
    keep = texts_with >= LEAST_TEXTS
    keep[WORD_DIM:] = texts_with[WORD_DIM:] > 0
    used = np.flatnonzero(keep)
    number = np.cumsum(keep, dtype=np.int32) - 1
    size = sum(int(keep[col].sum()) for col, _ in held)
    rows, cols, vals = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, np.float32)
    end = 0
    for row, (col, val) in enumerate(held):
        at = keep[col]
        own = slice(end, end := end + int(at.sum()))
        rows[own], cols[own], vals[own] = row, number[col[at]], val[at]
    return Sample(rows, cols, vals, len(held), used)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; deterministic."""
    x = start
    value, slope = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q = slope.copy()
        alphas = []
        for s, y, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y, rho), alpha in zip(steps, reversed(alphas), strict=True):
            q += s * (alpha - rho * (y @ q))
        down, size = -(q @ slope), 1.0
        if down >= 0:
            break
        while True:
            new = x - size * q
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * size * down or size < 1e-8:
                break
            size /= 2
        if size < 1e-8 or value - new_value < 1e-5 * abs(value):
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        x, value, slope = new, new_value, new_slope
    return x


def score_frame(docs: DataFrame, score: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: str) -> DataFrame:
    """doc_id and the scored columns, in Arrow batches."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | score(batch))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {schema}")


def filter_frame(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that ``keep`` finds, with all their columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at))))

    return docs.mapInArrow(run, docs.schema)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
