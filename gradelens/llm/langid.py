"""Operator 2, language ID: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

Training (numpy, stochastic gradient descent) uses a bounded sample of labelled rows
(``SAMPLE_ROWS``, dealt out evenly: of each language about as many, of rare ones all they have); prediction covers every whole text in
Arrow batches.  The model sees the text alone.

Defined results: NULL text or a text without a letter gets ``und``, score 0 and is not
accepted.  A language of few rows is learned from them; of more than ``LANGUAGES`` the commonest are learned.  Empty tables give empty results.  Rows are independent, so repeated rows and
ties give equal rows; a tie between languages takes the first in alphabetical order.
Input columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns
from gradelens.llm.subwords import Features, softmax, temperature, train_embeddings

#: Parameters: labelled rows that training may read, share of them that calibrates, precision asked of accepted rows.
SAMPLE_ROWS = 3000
#: Parameter: languages that are learned at most.
LANGUAGES = 500
CALIBRATION = 5
PRECISION = 0.99
UNDETERMINED = "und"
FEATURES = Features(bits=14, orders=(2, 3, 4), fold=True)
ASCII_LETTER = T.byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    threshold: float

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return softmax((FEATURES.score(self.table, data, at) + self.bias) / self.heat)


def segments(texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Whole texts, and the last line of each as a short text of the same label."""
    short = [(t.rsplit("\n", 1)[-1], y) for t, y in zip(texts, labels)]
    short = [(t, y) for t, y in short if any(c.isalpha() for c in t)]
    return texts + [t for t, _ in short], np.concatenate([labels, np.array([y for _, y in short], labels.dtype)])


def even_sample(known: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows (2 * ``rows`` at most, one per language at least) of (i, t, y), chosen by a hash of ``i``, as many of each ``y``."""
    counts = [(r["y"], r["count"]) for r in known.groupBy("y").count().orderBy(F.desc("count"), "y").limit(LANGUAGES).collect()]
    if not counts:
        return known.limit(0)
    # rare languages leave their part to the others
    share, left, open_ = 0, rows, len(counts)
    for _, n in sorted(counts, key=lambda c: c[1]):
        share = max(left // open_, 1)
        left -= min(n, share)
        open_ -= 1
    limits = F.create_map(*[x for y, n in counts for x in (F.lit(y), F.lit(int(min(1.0, 1.0 * share / n) * (1 << 32))))])
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col("i").cast("string")), F.lit(1 << 32)) < F.try_element_at(limits, F.col("y"))
    return known.where(pick).limit(2 * max(rows, len(counts)))


def fit(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        rows: int = SAMPLE_ROWS, seed: int = 2) -> LanguageModel:
    """Train on a bounded sample of the rows with a language and a text; no such row gives a model that always says ``und``."""
    known = df.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("y")) \
        .where(F.col("y").isNotNull() & F.col("i").isNotNull())
    got = even_sample(known, rows, seed).toPandas()
    spoken = np.array([isinstance(t, str) and any(c.isalpha() for c in t) for t in got["t"]], bool)
    got = got.loc[spoken].sort_values(["i", "t"])
    langs = tuple(sorted(set(got["y"])))
    if not langs:
        return LanguageModel((), np.zeros((FEATURES.size, 1), np.float32), np.zeros(1), 1.0, 1.0)
    y = np.array([langs.index(v) for v in got["y"]])
    texts = list(got["t"])
    held = np.arange(len(y)) % CALIBRATION == 0 if len(y) >= 10 * CALIBRATION else np.zeros(len(y), bool)
    seen, seen_y = segments([t for t, h in zip(texts, held) if not h], y[~held])
    table, bias = train_embeddings(FEATURES.counts(seen), seen_y, FEATURES.size, len(langs), seed=seed)
    if not held.any():
        return LanguageModel(langs, table, bias, 1.0, 0.5)
    cal, cal_y = segments([t for t, h in zip(texts, held) if h], y[held])
    z = np.array([(table[i] * v[:, None]).sum(0) for i, v in FEATURES.counts(cal)]) + bias
    heat = temperature(z, cal_y)
    p = softmax(z / heat)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == cal_y)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(langs, table, bias, heat, threshold)


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row has a letter (any script)."""
    ascii_ = T.row_sums(ASCII_LETTER[data].astype(np.int64), at) > 0
    for i in np.flatnonzero(~ascii_ & (at[1:] > at[:-1])):
        ascii_[i] = any(c.isalpha() for c in data[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
    return ascii_


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (calibrated probability) and ``accepted`` (score at or over the threshold)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        names = np.array(list(m.langs) or [UNDETERMINED], dtype=object)
        label, score = [], []
        for _, _, data, at in T.slices(*T.utf8(T.column(batch, text))):
            p = m.probabilities(data, at)
            known = has_letter(data, at) & bool(m.langs)
            label.append(np.where(known, names[p.argmax(1)], UNDETERMINED))
            score.append(np.where(known, p.max(1), 0.0))
        label, score = np.concatenate(label or [[]]), np.concatenate(score or [[]]).astype(float)
        return [pa.array(list(label), pa.string()), pa.array(score), pa.array((score >= m.threshold) & (label != UNDETERMINED))]

    return add_columns(df, {"lang_pred": "string", "score": "double", "accepted": "boolean"}, run)
