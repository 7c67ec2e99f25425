"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text gives a few statistics; cosine features of fixed random directions approximate a Gaussian
kernel over them. Every task sums its part of the normal equations and the driver solves one system of
``FEATURES`` unknowns. Scores are calibrated by isotonic regression on a histogram of ``BINS`` score
bins, so no row of the training set leaves its task.

Only rows of ``labels`` outside the held-out fold are learned from. A score depends on the text alone.

Defined cases: a null or empty text has zero statistics and is scored like any other. Several labels of
one document are averaged; null labels are ignored. Repeated rows are scored each, extra columns are
ignored, an empty table gives an empty result. Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import any_names, blocks, bound_batches, in_crc, materialize, utf8
from lattica.llm.textstats import NAMES, block_stats, column_matrix, summed, text_stats

FEATURES, SEED, WIDTH, RIDGE, BINS = 192, 11, 2.5, 1e-3, 2048


def training_rows(stats: DataFrame, labels: DataFrame, label: str, modulo: int, rest: int) -> DataFrame:
    """(stats, y): labelled documents outside the held-out fold, with the mean of their labels."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL").where(in_crc("doc_id", modulo, rest, False)).groupBy("doc_id").agg(F.avg("y").alias("y"))
    return stats.join(y, "doc_id").select("stats", "y")


def _features(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / std, -6, 6)
    return np.c_[np.cos(z @ w + b) * np.sqrt(2 / FEATURES), np.ones(len(x))]


def isotonic(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing probabilities of bins by pool-adjacent-violators; bins without rows follow their neighbours."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(weight):
        pools.append([weight[i], positive[i], i, i])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, p, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + p, pools[-1][2], last]
    if not pools:
        return np.full(len(weight), 0.5)
    at = [x for _, _, a, b in pools for x in (a, b + 1e-6)]
    steps = np.interp(np.arange(len(weight)), at, [(p + 0.02) / (n + 0.04) for n, p, _, _ in pools for _ in range(2)])
    return 0.998 * steps + 0.002 * np.arange(len(weight)) / len(weight)


def fit(train: DataFrame) -> dict:
    """The model, from partition sums over (stats, y)."""
    d = len(NAMES)

    def moments(batch):
        x = column_matrix(batch.column(0), d)
        return np.stack([np.ones(d) * len(x), x.sum(0), (x * x).sum(0)])

    m = summed(train, moments, d)
    if not len(m):
        return {"mean": np.zeros(d), "std": np.ones(d), "beta": np.zeros(FEATURES + 1), "low": 0.0, "high": 1.0, "curve": np.full(BINS, 0.5)}
    mean = m[1] / m[0]
    std = np.sqrt(np.maximum(m[2] / m[0] - mean ** 2, 1e-12)) + 1e-6

    def normal(batch):
        f = _features(column_matrix(batch.column(0), d), mean, std)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return np.c_[f.T @ f, f.T @ y]

    n = summed(train, normal, FEATURES + 2)
    count = m[0, 0]
    beta = np.linalg.solve(n[:, :-1] + RIDGE * count / FEATURES * np.diag([1.0] * FEATURES + [0.0]), n[:, -1])

    def histogram(batch):
        raw = _features(column_matrix(batch.column(0), d), mean, std) @ beta
        y = batch.column(1).to_numpy(zero_copy_only=False)
        to = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(to, minlength=BINS), np.bincount(to, y, BINS)]).astype(float)

    h = summed(train, histogram, BINS)
    return {"mean": mean, "std": std, "beta": beta, "curve": isotonic(h[0], h[1])}


def score_stats(model: dict, x: np.ndarray) -> np.ndarray:
    raw = _features(x, model["mean"], model["std"]) @ model["beta"]
    return np.clip(np.interp((raw + 0.5) / 2 * BINS - 0.5, np.arange(BINS), model["curve"]), 0, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, modulo: int = 5, rest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = materialize(text_stats(docs, id_col, text_col))
    model = fit(training_rows(stats, labels, label, modulo, rest))

    def run(batches):
        for b in batches:
            score = score_stats(model, column_matrix(b.column(1), len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", in_crc("doc_id", modulo, rest, True).alias("held_out"), "score", "predicted")


@any_names
def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulo: int = 5, rest: int = 0, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; the same columns, and no shuffle of texts."""
    bound_batches(docs.sparkSession)
    model = fit(training_rows(materialize(text_stats(docs, id_col, text_col)), labels, label, modulo, rest))

    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(text_col))
            good = [score_stats(model, block_stats(raw[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x])) >= threshold for x, y in blocks(offsets)]
            if good:
                yield b.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
