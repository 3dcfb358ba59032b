"""Toxicity classifier: linear over character n-grams scaled by naive Bayes log-count ratios.

A text is its set of character n-grams (3 to 6 code points, A-Z lower-cased, white space as one
blank, a blank before and after the text), hashed into ``BUCKETS``.  Training has two parts:

* the log-count ratio of every bucket, log of its smoothed share among toxic texts over its share
  among the others, from the document counts of *all* usable labelled rows (partial counts per
  task, summed by a shuffle; at most one row per bucket reaches the driver).  Buckets whose ratio
  is within ``MIN_Z`` standard errors of zero carry no evidence and are left out, and of the rest
  the ``MAX_FEATURES`` with the largest number of standard errors are kept;
* a logistic regression on the ratios of the n-grams that a text holds, fitted on at most
  ``max_rows`` labelled rows of each class (smallest id hash), each class weighted back to its
  share of all labelled rows.

Scoring covers every row and its whole text.  Ids, sources, languages and labels are never inputs.

Defined results: null and empty texts have no n-grams and get the score of the bias; without rows
of both classes every score is 0.5; labels other than 0 and 1 and null ids take no part in
training; an id labelled both ways counts as toxic; repeated rows are trained on and scored like any
other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.llm.staging import drop, release_shuffles, stage
from postmetrics.llm.textops import LOWER, SPACES, mix, sorted_distinct

LENGTHS = (3, 4, 5, 6)
BITS = 18
BUCKETS = 1 << BITS
SMOOTHING = 1.0
MIN_Z = 3.0
MAX_FEATURES = 16_384
MAX_ROWS = 4_000
STEP_CHARS = 1 << 18

#: Multipliers of the n-gram hash, one for each place of an n-gram.
_FACTORS = mix(np.arange(1, max(LENGTHS) + 1, dtype=np.uint64)) | np.uint64(1)
_FOLD = LOWER.astype(np.uint32)
_FOLD[SPACES] = 32


def _characters(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each between two blanks, and where each text starts."""
    padded = [f" {t or ''} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ascii_ = codes < 128
    codes[ascii_] = _FOLD[codes[ascii_]]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in padded], out=starts[1:])
    return codes, starts


def n_grams(texts: list, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct n-gram bucket of every text, in order.

    ``wanted``: boolean per bucket, where only some of them matter.
    """
    rows, buckets, lo = [], [], 0
    while lo < len(texts):  # slices of whole texts, of bounded length unless one text is longer
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= STEP_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        codes, starts = _characters(texts[lo:hi])
        wide, owner = codes.astype(np.uint64), np.repeat(np.arange(hi - lo), np.diff(starts))
        keys = []
        total = np.zeros(len(wide), np.uint64)
        for n in range(1, max(LENGTHS) + 1):  # the hash of n characters extends that of n - 1
            count = len(wide) - n + 1
            if count <= 0:
                break
            total = total[:count] + wide[n - 1:] * _FACTORS[n - 1]
            if n not in LENGTHS:
                continue
            bucket = (total >> np.uint64(64 - BITS)).astype(np.int64)
            at = np.arange(count) if wanted is None else np.flatnonzero(wanted[bucket])
            row = owner[at]
            inside = at + n <= starts[row + 1]
            keys.append((row[inside] << BITS) | bucket[at[inside]])
        found = sorted_distinct(np.concatenate(keys))[0] if keys else np.zeros(0, np.int64)
        rows.append((found >> BITS) + lo)
        buckets.append(found & (BUCKETS - 1))
        lo = hi
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(buckets or [none])


@dataclass
class Model:
    """``weights`` per bucket (log-count ratio times fitted coefficient, 0 where left out) and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: list) -> np.ndarray:
        rows, buckets = n_grams(texts, self.weights != 0)
        margin = self.bias + np.bincount(rows, self.weights[buckets], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, smoothing: float = SMOOTHING,
                     min_z: float = MIN_Z, most: int = MAX_FEATURES) -> np.ndarray:
    """Log of the smoothed shares' ratio per bucket; 0 where it is within ``min_z`` standard errors of 0, or
    not among the ``most`` of most standard errors."""
    p, q = toxic + smoothing, clean + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    z = np.where(toxic + clean > 0, np.abs(ratio) / np.sqrt(1 / p + 1 / q), 0.0)
    z[np.argsort(-z, kind="stable")[most:]] = 0.0
    return np.where(z >= min_z, ratio, 0.0)


def fit(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ratios: np.ndarray,
        steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Weighted logistic regression (Adam) on the entries (row, bucket) of the sampled texts."""
    used, column = np.unique(buckets, return_inverse=True)
    value, y = ratios[buckets], toxic.astype(np.float64)
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, value * w[column], minlength=len(y))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        full = np.append(np.bincount(column, value * g[rows], minlength=len(used)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(BUCKETS)
    weights[used] = ratios[used] * w
    return Model(weights, float(b))


def document_counts(rows: DataFrame) -> DataFrame:
    """bucket, toxic, clean: number of labelled texts (``text``, ``label``) of each class that hold it."""
    def run(batches):
        held = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            row, bucket = n_grams(b.column("text").to_pylist())
            for k in (0, 1):
                held[k] += np.bincount(bucket[label[row] == k], minlength=BUCKETS)
        at = np.flatnonzero(held.any(0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[1][at]), pa.array(held[0][at])],
                                             names=["bucket", "toxic", "clean"])

    parts = rows.select("text", "label").mapInArrow(run, "bucket long, toxic long, clean long")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on the labelled rows for which ``usable`` (a condition on the column ``id``) holds; None
    if a class is missing."""
    usable = F.lit(True) if usable is None else usable
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(usable)
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    # the same join at every size: labels grow with the documents
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(usable).join(marks.hint("merge"), "id"), "labelled")
    release_shuffles(docs.sparkSession)

    counts = document_counts(rows).toArrow()  # one row per bucket at most
    held = np.zeros((2, BUCKETS))
    at = counts.column("bucket").to_numpy()
    held[1][at], held[0][at] = counts.column("toxic").to_numpy(), counts.column("clean").to_numpy()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        drop(rows)
        return None
    ratios = log_count_ratios(held[1], held[0])
    wanted = ratios != 0

    def sparse(batches):
        for b in batches:
            row, bucket = n_grams(b.column("text").to_pylist(), wanted)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), lists], names=["id", "label", "buckets"])

    ids = rows.select("id", "label").distinct()
    chosen = [ids.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id") for k in (0, 1)]
    sampled = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id", "left_semi").select("id", "text", "label")
    kind = rows.schema["id"].dataType.simpleString()
    # of rows that share an id one stands for it, the same in every run
    taken = sampled.mapInArrow(sparse, f"id {kind}, label int, buckets array<int>").groupBy("id").agg(
        F.min(F.struct("label", "buckets")).alias("r")).select("r.label", "r.buckets").toArrow()
    drop(rows)
    toxic = taken.column("label").to_numpy()
    weight = np.where(toxic == 1, sizes[1] / max(1, (toxic == 1).sum()), sizes[0] / max(1, (toxic == 0).sum()))
    lists = taken.column("buckets").combine_chunks()
    row = np.repeat(np.arange(len(toxic)), np.diff(lists.offsets.to_numpy()))
    return fit(row, lists.flatten().to_numpy(), toxic, weight, ratios)


def score(self, texts: list) -> np.ndarray:
        rows, buckets = n_grams(texts, self.weights != 0)
        margin = self.bias + np.bincount(rows, self.weights[buckets], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, smoothing: float = SMOOTHING,
                     min_z: float = MIN_Z, most: int = MAX_FEATURES) -> np.ndarray:
    """Log of the smoothed shares' ratio per bucket; 0 where it is within ``min_z`` standard errors of 0, or
    not among the ``most`` of most standard errors."""
    p, q = toxic + smoothing, clean + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    z = np.where(toxic + clean > 0, np.abs(ratio) / np.sqrt(1 / p + 1 / q), 0.0)
    z[np.argsort(-z, kind="stable")[most:]] = 0.0
    return np.where(z >= min_z, ratio, 0.0)


def fit(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ratios: np.ndarray,
        steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Weighted logistic regression (Adam) on the entries (row, bucket) of the sampled texts."""
    used, column = np.unique(buckets, return_inverse=True)
    value, y = ratios[buckets], toxic.astype(np.float64)
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, value * w[column], minlength=len(y))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / total
        full = np.append(np.bincount(column, value * g[rows], minlength=len(used)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full ** 2
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(BUCKETS)
    weights[used] = ratios[used] * w
    return Model(weights, float(b))


def document_counts(rows: DataFrame) -> DataFrame:
    """bucket, toxic, clean: number of labelled texts (``text``, ``label``) of each class that hold it."""
    def run(batches):
        held = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            row, bucket = n_grams(b.column("text").to_pylist())
            for k in (0, 1):
                held[k] += np.bincount(bucket[label[row] == k], minlength=BUCKETS)
        at = np.flatnonzero(held.any(0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[1][at]), pa.array(held[0][at])],
                                             names=["bucket", "toxic", "clean"])

    parts = rows.select("text", "label").mapInArrow(run, "bucket long, toxic long, clean long")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fit on the labelled rows for which ``usable`` (a condition on the column ``id``) holds; None
    if a class is missing."""
    usable = F.lit(True) if usable is None else usable
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(usable)
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    # the same join at every size: labels grow with the documents
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(usable).join(marks.hint("merge"), "id"), "labelled")
    release_shuffles(docs.sparkSession)

    counts = document_counts(rows).toArrow()  # one row per bucket at most
    held = np.zeros((2, BUCKETS))
    at = counts.column("bucket").to_numpy()
    held[1][at], held[0][at] = counts.column("toxic").to_numpy(), counts.column("clean").to_numpy()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        drop(rows)
        return None
    ratios = log_count_ratios(held[1], held[0])
    wanted = ratios != 0

    def sparse(batches):
        for b in batches:
            row, bucket = n_grams(b.column("text").to_pylist(), wanted)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), lists], names=["id", "label", "buckets"])

    ids = rows.select("id", "label").distinct()
    chosen = [ids.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id") for k in (0, 1)]
    sampled = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id", "left_semi").select("id", "text", "label")
    kind = rows.schema["id"].dataType.simpleString()
    # of rows that share an id one stands for it, the same in every run
    taken = sampled.mapInArrow(sparse, f"id {kind}, label int, buckets array<int>").groupBy("id").agg(
        F.min(F.struct("label", "buckets")).alias("r")).select("r.label", "r.buckets").toArrow()
    drop(rows)
    lists = taken.column("buckets").to_pylist()
    toxic = taken.column("label").to_numpy()
    weight = np.where(toxic == 1, sizes[1] / max(1, (toxic == 1).sum()), sizes[0] / max(1, (toxic == 0).sum()))
    row = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    flat = np.concatenate([np.asarray(p, np.int64) for p in lists]) if lists else np.zeros(0, np.int64)
    return fit(row, flat, toxic, weight, ratios)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``score`` of every row."""
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            s = np.full(len(texts), 0.5) if model is None else model.score(texts)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
