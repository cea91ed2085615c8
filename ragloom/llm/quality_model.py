"""Quality classifier: kernel ridge by random Fourier features, calibrated.

Statistics of a whole text are standardised and mapped to random Fourier
features of a Gaussian kernel. Ridge weights solve the normal equations; each
task sums its own features' products and only those sums are shuffled (added in
two levels), so any number of labelled rows can be used. Raw scores are calibrated
by isotonic regression on a histogram of training scores.

The text is read once: statistics of all documents are written, then training,
calibration and scoring work on that table.

Defined results: a null text is empty and has all-zero statistics; every row is
scored, repeated rows alike; several labels of one id count as their rounded
mean; null labels and ids are not learned from; without labels every score is
0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .stats import FIELDS, text_stats

FEATURES = 256
RIDGE = 1e-3
SEED = 5
#: Score bins of the calibration.
BINS = 512


def features(s: np.ndarray) -> np.ndarray:
    """Statistics (columns as ``FIELDS``) -> inputs of the kernel."""
    s = s.astype(float)
    col = {f: s[:, i] for i, f in enumerate(FIELDS)}
    words, chars = np.maximum(col["n_words"], 1), np.maximum(col["word_chars"], 1)
    lines = np.maximum(col["n_lines"], 1)
    ratio = [col["word_chars"] / words, 10 * col["n_symbols"] / chars, 10 * col["n_upper"] / chars,
             10 * col["n_digits"] / chars, 10 * col["n_punctuation"] / chars,
             col["n_types"] / words, col["n_repeat_words"] / words, col["n_dup_lines"] / lines,
             10 * col["n_bars"] / words, np.log1p(words) / 2, np.log1p(words / lines),
             np.log1p(col["longest"])]
    return np.stack(ratio, 1)


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(rows, texts):
        x = features(np.array([text_stats(t) for t in texts]).reshape(len(texts), len(FIELDS)))
        flat = pa.array(x.ravel())
        return [rows.column(0), pa.ListArray.from_arrays(
            pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)]

    return map_texts(docs, [id_col], run, f"`{id_col}` {kind}, _x array<double>", text_col)


class Fourier:
    """cos(W z + b) of the standardised statistics z, and a constant."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.maximum(std, 1e-3)
        width = np.sqrt(len(mean))
        self.w = rng.normal(size=(len(mean), count)) / width
        self.b = rng.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -5, 5)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([f, np.ones((len(f), 1))], 1)


def _matrix(col: pa.Array) -> np.ndarray:
    width = len(col[0]) if len(col) else 0
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(v, float) for v in pdf["v"])
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "v": [total.tobytes()]})


def added(parts: DataFrame) -> np.ndarray | None:
    """Sum of (part int, v binary) vectors in two levels, one row to the driver."""
    kind = "part int, v binary"
    two = (parts.groupBy("part").applyInPandas(lambda k, p: _sum(p), kind)
           .withColumn("part", F.lit(0)).groupBy("part").applyInPandas(lambda k, p: _sum(p), kind))
    got = two.collect()
    return np.frombuffer(got[0]["v"], float) if got else None


def task_sums(rows: DataFrame, fn) -> np.ndarray | None:
    """``fn(x, y)`` -> vector, summed over all batches of (_x, _y)."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                v = fn(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = v if total is None else total + v
        if total is not None:
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                names=["part", "v"])

    return added(rows.select("_x", "_y").mapInArrow(run, "part int, v binary"))


def isotonic(score: np.ndarray, count: np.ndarray, hits: np.ndarray):
    """Pool adjacent violators -> (x, y) of a non-decreasing line through the pools."""
    pools: list[list[float]] = []
    for s, c, h in zip(score, count, hits):
        pools.append([s * c, c, h])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return (np.array([p[0] / p[1] for p in pools]),
            np.array([(p[2] + 0.5 * 1e-3) / (p[1] + 1e-3) for p in pools]))


def labels_by_id(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("_lid")).agg(F.round(F.avg(label_col)).alias("_y")))


def fit(train: DataFrame, count: int = FEATURES, ridge: float = RIDGE, seed: int = SEED):
    """(_x, _y) rows -> a function from statistics to scores, or None without rows."""
    moments = task_sums(train, lambda x, y: np.concatenate(
        [[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if moments is None:
        return None
    n, p = moments[0], (len(moments) - 2) // 2
    mean = moments[2:2 + p] / n
    phi = Fourier(mean, np.sqrt(np.maximum(moments[2 + p:] / n - mean ** 2, 0)), count, seed)
    m = count + 1

    def normal(x, y):
        f = phi(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    sums = task_sums(train, normal)
    weights = np.linalg.solve(sums[:m * m].reshape(m, m) + ridge * n / m * np.eye(m), sums[m * m:])
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(x, y):
        s = phi(x) @ weights
        b = np.clip(np.searchsorted(edges, s, "right") - 1, 0, BINS - 1)
        return np.concatenate([np.bincount(b, w, BINS) for w in (s, np.ones(len(s)), y)])

    h = task_sums(train, histogram).reshape(3, BINS)
    full = h[1] > 0
    line = isotonic(h[0][full] / h[1][full], h[1][full], h[2][full])

    def score(x):
        raw = phi(x) @ weights
        # a small share of the raw score keeps the order inside a pool
        return np.clip(0.99 * np.interp(raw, *line) + 0.01 * np.clip(raw, 0, 1), 0, 1)

    return score


def score_quality(docs: DataFrame, labels: DataFrame, train: F.Column, threshold: float = 0.3,
                  id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  **options) -> DataFrame:
    """(id, score, predicted) of every row of ``docs``; ``train`` says which rows' labels
    may be learned."""
    table = written(statistics(docs, id_col, text_col), "quality-statistics")
    marks = labels_by_id(labels, id_col, label_col)
    model = fit(table.where(train).join(marks, F.col(id_col) == F.col("_lid")), **options)
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = (model(_matrix(b.column(1))) if model and b.num_rows
                 else np.full(b.num_rows, 0.5))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[id_col, "score", "predicted"])

    return table.select(id_col, "_x").mapInArrow(
        run, f"`{id_col}` {kind}, score double, predicted int")
