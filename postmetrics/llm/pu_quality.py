"""Quality classifier by positive-unlabelled learning.

A logistic model over features of whole texts is fitted by minimising the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

on trusted positives and unlabelled texts.  The class prior comes from the same two samples: a first
classifier (positives against unlabelled) orders them, and the prior is the smallest ratio of the
shares above a score (best bin, with a confidence term).  Both samples are bounded: the
``max_positives`` and ``max_unlabelled`` rows with the smallest id hash.  Scoring covers every row.

Features: shares of byte classes and of single punctuation marks, word and line shape, and
repetition.  Ids, sources, languages and labels are never features.

Defined results: null and empty texts have the features of an empty text and get a score; without
positives or without unlabelled texts every score is 0.5; repeated rows and null ids are scored like
any other row (null ids take no part in fitting); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.textops import LOWER, prefix_sums, row_of, row_slices, span_hash, text_buffer, word_spans

MAX_POSITIVES = 6_000
MAX_UNLABELLED = 12_000
STEP_BYTES = 1 << 19

_CLASS = np.full(256, 7, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[0x20] = 3
_CLASS[[0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
_CLASS[128:] = 6
_MARKS = b".,;:!?|%#$&*'\"()-/_=+<>@"
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = 8 + _k
N_CLASSES = 8 + len(_MARKS)
N_SHAPE = 12
N_FEATURES = N_CLASSES + N_SHAPE


def features(texts: pa.Array) -> np.ndarray:
    """float32 matrix, one row of ``N_FEATURES`` for each text, over its whole length."""
    buf, starts, ends = text_buffer(texts)
    out = np.zeros((len(starts), N_FEATURES), np.float32)
    for lo, hi in row_slices(starts, ends, STEP_BYTES):
        part = buf[starts[lo]:ends[hi - 1]]
        if len(part):
            out[lo:hi] = _features(part, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
    return out


def _features(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n, rows = len(s), np.repeat(np.arange(len(s)), e - s)
    size = np.maximum(e - s, 1).astype(np.float64)

    def per_row(at, weights=None):
        return np.bincount(at, weights=weights, minlength=n).astype(np.float64)

    classes = np.bincount(rows * N_CLASSES + _CLASS[part], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / size[:, None]
    ws, we, wr = word_spans(part, s, e)
    words = np.maximum(per_row(wr), 1)
    length = (we - ws).astype(np.float64)
    mean = per_row(wr, length) / words
    spread = np.sqrt(np.maximum(per_row(wr, length ** 2) / words - mean ** 2, 0))
    last = _CLASS[part[we - 1]] if len(we) else np.zeros(0, np.uint8)
    keys = span_hash(prefix_sums(LOWER[part]), ws, we) if len(ws) else np.zeros(0, np.uint64)
    order = np.lexsort((keys, wr))
    k, r = keys[order], wr[order]
    again = np.concatenate(([False], (k[1:] == k[:-1]) & (r[1:] == r[:-1]))) if len(k) else np.zeros(0, bool)
    breaks = part == 0x0A
    lines = per_row(rows[breaks]) + 1
    shape = np.stack([
        np.log1p(words), mean / 10, spread / 10, per_row(wr[length == 1]) / words, per_row(wr[length > 14]) / words,
        per_row(wr[last >= 7]) / words, per_row(r[again]) / words, np.log1p(size) / 10, lines / words,
        np.log1p(size / lines) / 5, per_row(wr[_CLASS[part[ws]] == 1] if len(ws) else wr) / words,
        per_row(wr[_CLASS[part[we - 1]] == 1] if len(we) else wr) / words], axis=1)
    return np.concatenate([np.sqrt(classes), shape], axis=1)


@dataclass
class Model:
    """Weights over standardised features; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).astype(np.float64) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _descend(x: np.ndarray, risk_gradient, steps: int = 400, rate: float = 0.03, decay: float = 1e-3):
    """Adam on weights and bias; ``risk_gradient`` gives d risk / d margin for every row."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        g = risk_gradient(x @ w + b)
        full = np.append(x.T @ g + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate: min over scores of (unlabelled share above) / (positive share above)."""
    p, u = np.sort(positive_scores), np.sort(unlabelled_scores)
    at = np.quantile(p, np.linspace(0.0, 0.95, 96))
    above_p = 1 - np.searchsorted(p, at) / len(p)
    above_u = 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """Non-negative PU fit on two feature matrices; None if either is empty."""
    if not len(positives) or not len(unlabelled):
        return None
    both = np.concatenate([positives, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-6] = 1.0
    x = (both - mean) / scale
    n_p, n_u = len(positives), len(unlabelled)
    is_p = np.arange(len(x)) < n_p

    def against_unlabelled(z):
        return np.where(is_p, (_sigmoid(z) - 1) / n_p, _sigmoid(z) / n_u) / 2

    w, b = _descend(x, against_unlabelled)
    z = x @ w + b
    prior = estimate_prior(z[:n_p], z[n_p:])

    def non_negative(z):
        # logistic losses: l(z) = log(1 + exp(-z)) for positives, l(-z) for negatives
        p, u = _sigmoid(z[:n_p]), _sigmoid(z[n_p:])
        negative_risk = np.logaddexp(0, z[n_p:]).mean() - prior * np.logaddexp(0, z[:n_p]).mean()
        g = np.zeros(len(z))
        if negative_risk < 0:  # step back up until the estimated risk of negatives is not below 0
            g[:n_p], g[n_p:] = prior * p / n_p, -u / n_u
            return g
        g[:n_p] = prior * (p - 1) / n_p - prior * p / n_p
        g[n_p:] = u / n_u
        return g

    w, b = _descend(x, non_negative)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w, float(b), prior)


def _sample_features(docs: DataFrame, ids: DataFrame, most: int, seed: int, text_col: str) -> np.ndarray:
    """Features of the rows of at most ``most`` ids, those with the smallest hash."""
    chosen = ids.select("id").where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)

    def run(batches):
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])
    rows = docs.join(F.broadcast(chosen), "id", "left_semi").select(text_col).mapInArrow(run, "x binary").limit(2 * most).toArrow()
    return np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on ``usable`` rows (a condition on the column ``id``; all rows if None)."""
    usable = F.lit(True) if usable is None else usable
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(usable)
    positive = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label = 1").where(usable)
    p = _sample_features(rows, positive, max_positives, 1, "text")
    u = _sample_features(rows, rows, max_unlabelled, 2, "text")
    return fit(p, u)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list | None = None) -> DataFrame:
    """The id column, or a struct ``row`` of the columns ``keep``, and ``score`` of every row."""
    def run(batches):
        for b in batches:
            x = features(b.column(0))
            s = np.full(len(x), 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64())], names=["row", "score"])

    rows = docs.select(F.col(text_col).alias("text"), (F.struct(*keep) if keep else F.col(id_col)).alias("row"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out if keep else out.withColumnRenamed("row", id_col)
