"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's rating is graded from its labels: 0 poor, 1 good but toxic, 2 good and clean. One set of
hashed-text weights gives a latent score f, and ordered thresholds give P(grade >= j) = logistic(f - t_j).
Selection keeps documents whose tail probability P(grade >= 2) reaches a fixed threshold; the
expected grade is for ranking. The model is fitted on a bounded sample of labelled documents.

Defined cases: a null or empty text is scored like any other, by the bias alone; grades that the
sample lacks give no threshold of their own, and with fewer than two grades all documents are kept;
repeated rows get equal results; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import labelled
from tidemark.llm.common import documents

GRADES = 3
#: Fixed threshold of P(grade >= 2): what is clean with less than this probability goes. It is the highest tenth that
#: keeps 99 % of the clean labelled documents when each is scored by a model fitted on the other three quarters.
THRESHOLD = 0.7
DECAY = 1e-3


def grade(quality: int, toxic: int) -> int:
    return 0 if quality <= 0 else 1 if toxic > 0 else 2


@dataclass
class OrdinalModel:
    """Shared weights; ``thresholds`` ascend, one for each grade above the lowest. No weights: every tail is 1."""

    hashed: labelled.Hashed | None
    thresholds: np.ndarray

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... of every text."""
        if self.hashed is None:
            return np.ones((len(column), GRADES - 1))
        f = self.hashed.score_column(column)
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds[None, :], -50, 50)))


def telling(sample: labelled.Sample, level: np.ndarray, cut: int) -> np.ndarray:
    """How much each feature's presence tells of any threshold: the largest log ratio of its shares above and below,
    less two standard errors, and 0 if nothing is left. It scales the features, so that weight decay bears on those
    that say little and a few telling words outweigh many common ones.
    """
    out = np.zeros(sample.dim)
    for k in range(cut):
        above = level > k
        up = np.bincount(sample.col, weights=above[sample.row], minlength=sample.dim) + 0.5
        down = np.bincount(sample.col, weights=~above[sample.row], minlength=sample.dim) + 0.5
        ratio = np.abs(np.log(up / (above.sum() + 1)) - np.log(down / ((~above).sum() + 1)))
        out = np.maximum(out, ratio - 2 * np.sqrt(1 / up + 1 / down))
    return np.maximum(out, 0.0)


def fit(found: list[tuple[labelled.Bag | str, int, int]]) -> OrdinalModel:
    grades = np.array([grade(q, t) for _, q, t in found], np.int64)
    have = np.unique(grades)
    if len(have) < 2:
        return OrdinalModel(None, np.zeros(GRADES - 1))
    level = np.searchsorted(have, grades)
    cut = len(have) - 1
    sample = labelled.sparse([text for text, _, _ in found])
    scale = sample.scaled()
    told = telling(sample, level, cut)
    sample.val *= told[sample.col].astype(np.float32)
    sample.mean = sample.mean * told
    scale = scale * told
    n = len(level)

    def thresholds(raw: np.ndarray) -> np.ndarray:
        # First threshold free, the others above it by positive gaps: ordered by construction.
        return raw[0] + np.append(0.0, np.cumsum(np.exp(raw[1:])))

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        t, w = thresholds(p[:cut]), p[cut:]
        f = sample.times(w)
        # P(level = k) = tail_k - tail_(k+1), tail_0 = 1 and tail_(cut+1) = 0.
        tail = np.column_stack([np.ones(n), sigmoid(f[:, None] - t[None, :]), np.zeros(n)])
        each = np.arange(n)
        prob = np.maximum(tail[each, level] - tail[each, level + 1], 1e-12)
        steep = tail * (1 - tail)
        by_f = -(steep[each, level] - steep[each, level + 1]) / prob / n
        by_t = np.zeros(cut)
        for k in range(cut):
            up, down = level == k + 1, level == k
            by_t[k] = (steep[up, k + 1] / prob[up]).sum() / n - (steep[down, k + 1] / prob[down]).sum() / n
        by_raw = np.append(by_t.sum(), [by_t[k:].sum() * np.exp(p[k]) for k in range(1, cut)])
        value = -np.log(prob).mean() + DECAY * float(w @ w) / 2
        return value, np.append(by_raw, sample.times_transposed(by_f) + DECAY * w)

    p = labelled.minimise(loss, np.zeros(cut + sample.dim))
    t = thresholds(p[:cut])
    # A grade that the sample lacks takes the threshold of the next one that it has; above all of them none is reached.
    full = np.array([t[k - 1] if 0 < (k := int(np.searchsorted(have, j))) <= cut else (-50.0 if k == 0 else 50.0) for j in range(1, GRADES)])
    return OrdinalModel(sample.hashed(p[cut:] * scale, -float(sample.mean @ p[cut:])), full)


def train(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> OrdinalModel:
    return fit(labelled.labelled_sample(docs, labels, rows))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Tail probabilities, expected grade and verdict of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def columns(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        tails = shared.value.tails(batch.column("text"))
        return {
            "p_grade_1": pa.array(tails[:, 0]),
            "p_grade_2": pa.array(tails[:, 1]),
            "expected_grade": pa.array(tails.sum(axis=1)),
            "kept": pa.array(tails[:, -1] >= THRESHOLD),
        }

    return labelled.score_frame(docs, columns, "p_grade_1 double, p_grade_2 double, expected_grade double, kept boolean")


def keep_selected(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that are selected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return labelled.filter_frame(docs, lambda column: shared.value.tails(column)[:, -1] >= THRESHOLD)


def op8_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, labelled.labels_of(spark, sf_dir)))
