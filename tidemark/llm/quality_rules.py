"""Quality rules: fixed base rules, and a calibrated logistic regression on hashed n-grams against a fixed threshold.

The regression is fitted on a bounded sample of labelled documents (``labelled.SAMPLE_ROWS``), four
fifths of it for the weights and one fifth to calibrate its probabilities (Platt scaling). Documents
are scored whole, in Arrow batches.

Defined cases: a null or empty text has no words and fails the base rules; with no labels, or labels
of one kind, the base rules alone decide; repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import labelled
from tidemark.llm.common import documents
from tidemark.llm.textvec import RangeHash, byte_codes, chunks, counts_in, distinct, int64, owners, runs, seeded, space_mask, splitmix, sums_by

#: Fixed limits of the base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Fixed threshold of the calibrated probability that a document is good.
THRESHOLD = 0.5
#: Weight decay of the scaled weights.
DECAY = 1e-3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of each text."""
    space = space_mask(data)
    starts, ends = runs(~space, off)
    word_off = counts_in(starts, off)
    n_words = np.diff(word_off)
    # Code points: all bytes but the continuation bytes of UTF-8.
    word_chars = sums_by((((data & 0xC0) != 0x80) & ~space).astype(np.int64), off)
    n_symbols = sums_by(_SYMBOL[data].astype(np.int64), off)
    hashes = RangeHash(byte_codes(data))

    line_starts, line_ends = runs(data != 0x0A, off)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_off = counts_in(line_starts, off)
    _, _, distinct_off = distinct(hashes(line_starts, line_ends), line_off)
    n_dup_lines = np.diff(line_off) - np.diff(distinct_off)

    words = hashes(starts, ends)
    n_windows = np.maximum(n_words - WINDOW + 1, 0)
    window_off = np.append(0, np.cumsum(n_windows))
    at = np.repeat(word_off[:-1] - window_off[:-1], n_windows) + np.arange(window_off[-1])
    window = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(seeded(WINDOW, 11)):
        window += words[at + k] * (factor | np.uint64(1))
    window = splitmix(window)
    owner = owners(window_off)
    order = np.lexsort((window, owner))
    same = (window[order][1:] == window[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[:-1] |= same
    twice[1:] |= same
    repeated = np.zeros(len(words), bool)
    for k in range(WINDOW):
        repeated[at[order[twice]] + k] = True
    n_repeat_words = sums_by(repeated.astype(np.int64), word_off)
    return dict(zip(MEASURES, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), strict=True))


def fails(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])


@dataclass
class QualityModel:
    """Hashed weights and the line that turns a score into a calibrated log odds."""

    hashed: labelled.Hashed | None
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability that each text is good; 1 without a model."""
        if self.hashed is None:
            return np.ones(len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.hashed.score(data, off) + self.shift, -50, 50)))


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log loss, and its slope in each z."""
    loss = np.logaddexp(0, z) - y * z
    return float(loss.mean()), (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(y)


def fit(found: list[tuple[labelled.Bag | str, int, int]]) -> QualityModel:
    """The model of a labelled sample."""
    y = np.array([float(quality > 0) for _, quality, _ in found])
    if len(set(y)) < 2:
        return QualityModel(None)
    held = np.arange(len(y)) % 5 == 4
    whole = labelled.sparse([text for text, _, _ in found])
    scale = whole.scaled()
    train = ~held if len(set(y[~held])) == 2 else np.ones(len(y), bool)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = whole.times(w[1:]) + w[0]
        value, slope = _logistic(z[train], y[train])
        each = np.zeros(len(y))
        each[train] = slope
        return value + DECAY * float(w[1:] @ w[1:]) / 2, np.append(each.sum(), whole.times_transposed(each) + DECAY * w[1:])

    w = labelled.minimise(loss, np.zeros(whole.dim + 1))
    z = whole.times(w[1:]) + w[0]
    model = QualityModel(whole.hashed(w[1:] * scale, float(w[0] - whole.mean @ w[1:])))
    if len(set(y[held])) == 2:
        # Platt scaling: targets a little inside 0 and 1 keep a separable sample finite.
        good = y[held].sum()
        target = np.where(y[held] > 0, (good + 1) / (good + 2), 1 / (held.sum() - good + 2))

        def platt(ab: np.ndarray) -> tuple[float, np.ndarray]:
            value, slope = _logistic(ab[0] * z[held] + ab[1], target)
            return value, np.array([slope @ z[held], slope.sum()])

        model.slope, model.shift = map(float, labelled.minimise(platt, np.array([1.0, 0.0])))
    return model


def judged(model: QualityModel, column: pa.Array) -> dict[str, np.ndarray]:
    """Measures, base_failed, probability and kept of every text of a column."""
    parts = []
    for _, _, data, off in chunks(column):
        m = measures(data, off)
        bad = fails(m)
        p = model.probability(data, off)
        parts.append(m | {"base_failed": bad, "probability": p, "kept": ~bad & (p >= THRESHOLD)})
    kinds = dict.fromkeys(MEASURES, np.int64) | {"base_failed": bool, "probability": float, "kept": bool}
    return {k: np.concatenate([np.zeros(0, kind), *(x[k] for x in parts)]) for k, kind in kinds.items()}


def train(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> QualityModel:
    return fit(labelled.labelled_sample(docs, labels, rows))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The result of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = judged(shared.value, batch.column("text"))
        return {k: int64(v) if k in MEASURES else pa.array(v) for k, v in out.items()}

    return labelled.score_frame(docs, columns, ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return labelled.filter_frame(docs, lambda column: judged(shared.value, column)["kept"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, labelled.labels_of(spark, sf_dir)))
