"""Quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled good, the unlabelled set is training documents whatever their label.
The non-negative unbiased risk ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` of a logistic
model over binned text measures is minimised; where the second part is negative, the step goes against it.  The class
prior is estimated from the two samples: a first classifier of positives against unlabelled is fitted on one half, and on
the other half the least ratio of the two shares above a threshold bounds the share of positives in the unlabelled set.

Only labels of rows outside the held-out fold are read.  Both samples are bounded (``POSITIVES``, ``UNLABELLED``: those
with the smallest hashed ids); every document is scored.

Defined results: null and empty texts get the score of measures that are all zero; repeated rows the same score; a null
doc_id is never held out; of several labels of one id the larger counts; without positives all scores are 0.5; extra
columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm import line_quality
from blockwise.llm.common import held_out
from blockwise.session import stage

#: Bounds of the samples that the model is fitted on.
POSITIVES, UNLABELLED = 6000, 12000
#: Quantiles that bin each measure; fine at the upper end, where few but telling documents lie.
QUANTILES = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 0.93, 0.96, 0.99)
BINS, ROUNDS, RATE, RIDGE = len(QUANTILES) + 1, 300, 0.1, 1e-5
THRESHOLD = 0.3
MEASURES = 9 + 2 * (line_quality.FEATURES - 1)


def measures(text: bytes | None) -> list[float]:
    """Numbers that describe a text: counts of the base rules, words and lines, and the means of its lines' features."""
    base, lines, sizes = line_quality.read(text)
    n = base[0]
    if not n:
        return [0.0] * MEASURES
    words = (text or b"").split()
    counts = Counter(words)
    x = np.array(lines)[:, 1:]
    weights = np.array(sizes, dtype=float)
    return [log1p(n), base[1] / n, base[2] / n, base[3] / len(lines), base[4] / n, len(counts) / n, max(counts.values()) / n,
            sum(map(eq, words, words[1:])) / n, log1p(n / len(lines)), *x.mean(axis=0).tolist(), *(weights @ x / n).tolist()]


@dataclass
class Model:
    """Quantiles that bin each measure, and a weight per bin."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The place of each measure's bin among all bins."""
        return np.stack([np.searchsorted(e, x[:, j]) + j * BINS for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 0.5)
        return _sigmoid(self.weights[self.bins(x)].sum(axis=1) + self.bias)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _dot(bins: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The one-hot rows of the bins, and a one, times the weights."""
    return w[bins].sum(axis=1) + w[-1]


def _back(bins: np.ndarray, share: np.ndarray, width: int) -> np.ndarray:
    """The same rows, transposed, times a number for each row."""
    return np.append(np.bincount(bins.ravel(), np.repeat(share, bins.shape[1]), width), share.sum())


def _descend(gradient: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for k in range(1, ROUNDS + 1):
        g = gradient(w) + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, width: int) -> float:
    """Share of positives among the unlabelled, from rows of bins."""
    both, y = np.concatenate([p[::2], u[::2]]), np.concatenate([np.ones(len(p[::2])), np.zeros(len(u[::2]))])
    share = np.where(y == 1, 0.5 / len(p[::2]), 0.5 / len(u[::2]))
    w = _descend(lambda w: _back(both, share * (_sigmoid(_dot(both, w)) - y), width), width + 1)
    sp, su = np.sort(_dot(p[1::2], w)), np.sort(_dot(u[1::2], w))
    if not len(sp) or not len(su):
        return 0.5
    at = np.unique(sp)
    above_p, above_u = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def fit_samples(positives: np.ndarray, unlabelled: np.ndarray) -> Model:
    if not len(positives) or not len(unlabelled):
        return Model([], np.zeros(0), 0.0, 0.5)
    every = np.concatenate([positives, unlabelled])
    edges = [np.quantile(every[:, j], QUANTILES) for j in range(every.shape[1])]
    shape = Model(edges, np.zeros(0), 0.0, 0.5)
    width = BINS * every.shape[1]
    p, u = shape.bins(positives), shape.bins(unlabelled)
    prior = estimate_prior(p, u, width)

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = _dot(p, w), _dot(u, w)
        negative = np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp))
        yes_p, yes_u = _sigmoid(gp), _sigmoid(gu)
        of_negative = _back(u, yes_u / len(u), width) - prior * _back(p, yes_p / len(p), width)
        if negative < 0:
            return -of_negative
        return of_negative - prior * _back(p, (1 - yes_p) / len(p), width)

    w = _descend(gradient, width + 1)
    return Model(edges, w[:-1], float(w[-1]), prior)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(t.as_py()) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["positive"], pa.array(rows, pa.list_(pa.float64()))], names=["positive", "x"])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model:
    """The model, from bounded samples of the training rows."""
    training = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder)).select("doc_id").distinct()
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    spread = [F.xxhash64("doc_id"), F.col("doc_id")]
    positives = training.join(good, "doc_id").orderBy(*spread).limit(POSITIVES).withColumn("positive", F.lit(True))
    # hashed with another number in front, so that this sample does not start with the positives
    unlabelled = training.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(UNLABELLED).withColumn("positive", F.lit(False))
    chosen = F.broadcast(positives.unionByName(unlabelled))  # POSITIVES + UNLABELLED ids at most
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(chosen, "doc_id").select("positive", "text")
    # the limit is for ids that many rows share; written first, as a collected limit would run a few tasks after the other
    got = stage(texts.mapInArrow(_measured, "positive boolean, x array<double>").limit(2 * (POSITIVES + UNLABELLED))).toArrow()
    flags = got["positive"].to_numpy(zero_copy_only=False).astype(bool)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, MEASURES)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)  # rows come in any order
    x, flags = x[order], flags[order]
    return fit_samples(x[flags], x[~flags])


def _scored(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([measures(t.as_py()) for t in batch["text"]], dtype=float).reshape(-1, MEASURES)
            score = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, model: Model, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted (1 if the score is at least ``THRESHOLD``)."""
    texts = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")
