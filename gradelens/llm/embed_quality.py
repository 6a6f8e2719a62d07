"""Operator 5, quality classifier: supervised subword embeddings.

Learned vectors of hashed words, word pairs and character n-grams are averaged per
document; a softmax gives the label.  Training is numpy stochastic gradient descent on a
bounded sample of labelled rows (``SAMPLE_ROWS``); a Platt scale fitted on rows kept out of
the descent turns the margin into a probability.  Scoring covers every whole text.

Defined results: NULL and empty texts get the score of the bias alone.  Without labelled
rows of both values every score is 0.5.  Empty tables give empty results, repeated rows equal
scores; input columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns
from gradelens.llm.shared import bounded_sample
from gradelens.llm.subwords import Features, platt, train_embeddings

#: Parameters: labelled rows that training may read, every n-th of them calibrates, score from which a text counts as good.
SAMPLE_ROWS = 4000
CALIBRATION = 5
GOOD = 0.7
FEATURES = Features(bits=15, orders=(2, 3, 4), fold=False, words=True)


@dataclass(frozen=True)
class MarginModel:
    """One margin per text: a bucket table with a bias, and the Platt scale that makes it a probability."""

    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        margin = FEATURES.score(self.table, data, at)[:, 0] + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int, id_col: str = "doc_id",
                    text: str = "text", label: str = "quality"):
    """(texts, labels) of a bounded sample of the labelled documents, in id order.

    An id with several labels takes the smallest; the sampled ids are few by the bound, so they are broadcast.
    """
    marked = (labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y"))
              .where(F.col("i").isNotNull() & F.col("y").isin(0, 1)).groupBy("i").agg(F.min("y").alias("y")))
    few = bounded_sample(marked, "i", rows, seed)
    got = (docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
           .join(F.broadcast(few), "i").limit(2 * rows).toPandas().sort_values(["i", "t"]))
    return list(got["t"]), got["y"].to_numpy(np.int64)


def crops(texts: list[str], labels: np.ndarray, words: int = 12, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """The texts and, for each long one, a run of ``words`` words: short texts are met in training too."""
    rng = np.random.default_rng(seed)
    out, own = list(texts), list(labels)
    for t, y in zip(texts, labels):
        w = t.split()
        if len(w) > 2 * words:
            lo = int(rng.integers(0, len(w) - words))
            out.append(" ".join(w[lo:lo + words]))
            own.append(y)
    return out, np.array(own)


def calibrated(texts: list[str], y: np.ndarray, learn, seed: int) -> MarginModel:
    """Train with ``learn(rows, labels, class weights)`` on most rows, calibrate on the rest."""
    flat = MarginModel(np.zeros((FEATURES.size, 1), np.float32), 0.0, 1.0, 0.0)
    if len(set(y.tolist())) < 2:
        return flat
    held = np.arange(len(y)) % CALIBRATION == 0 if len(y) >= 10 * CALIBRATION else np.zeros(len(y), bool)
    if len(set(y[~held].tolist())) < 2:
        return flat
    seen, seen_y = crops([t for t, h in zip(texts, held) if not h], y[~held], seed=seed)
    share = np.bincount(seen_y, minlength=2) / len(seen_y)
    table, bias = learn(FEATURES.counts(seen), seen_y, 0.5 / share[seen_y])
    if not held.any():
        return MarginModel(table, bias, 1.0, 0.0)
    margin = np.array([(table[i, 0] * v).sum() for i, v in FEATURES.counts([t for t, h in zip(texts, held) if h])]) + bias
    slope, offset = platt(margin, y[held])
    return MarginModel(table, bias, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 5, **columns) -> MarginModel:
    """Train on documents that ``labels`` marks; restrict ``labels`` first to keep rows out of training."""
    texts, y = labelled_sample(docs, labels, rows, seed, **columns)

    def learn(counts, target, weights):
        table, bias = train_embeddings(counts, target, FEATURES.size, 2, seed=seed, weights=weights)
        return table[:, 1:] - table[:, :1], float(bias[1] - bias[0])

    return calibrated(texts, y, learn, seed)


def score(df: DataFrame, model: MarginModel, text: str = "text", good: float = GOOD) -> DataFrame:
    """``df`` with ``score`` (probability of a good text) and ``predicted`` (1 from ``good`` up)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        got = [shared.value.probabilities(data, at) for _, _, data, at in T.slices(*T.utf8(T.column(batch, text)))]
        p = np.concatenate(got or [np.zeros(0)])
        return [pa.array(p, pa.float64()), pa.array((p >= good).astype(np.int32), pa.int32())]

    return add_columns(df, {"score": "double", "predicted": "int"}, run)
