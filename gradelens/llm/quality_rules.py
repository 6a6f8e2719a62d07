"""Operator 7, quality rules: counted base rules and a calibrated hashed n-gram logistic regression.

Every whole text gets the base counts of its words and lines and, in the same Arrow pass, the
probability of a good text by logistic regression on hashed words, word pairs and character
n-grams (numpy stochastic gradient descent on a bounded sample of labelled rows, Platt scale).
Fixed thresholds give the verdict.  Windows and lines are compared by 64-bit hashes within one text.

Defined results: NULL and empty texts have no words, fail the base rules and are not kept.
Without labelled rows of both values the probability is 0.5, which keeps what passes the base
rules.  Empty tables give empty results, repeated rows equal rows; clashing input columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns
from gradelens.llm.embed_quality import FEATURES, MarginModel, calibrated, labelled_sample
from gradelens.llm.subwords import train_logistic

#: Parameters: labelled rows that training may read, least words, most repeated words in percent, least probability.
SAMPLE_ROWS = 4000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_QUALITY = 0.5
WINDOW = 3
SYMBOLS = T.byte_table(b"#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7, **columns) -> MarginModel:
    texts, y = labelled_sample(docs, labels, rows, seed, **columns)

    def learn(counts, target, weights):
        table, bias = train_logistic(counts, target, FEATURES.size, seed=seed, weights=weights)
        return table, float(bias[0])

    return calibrated(texts, y, learn, seed)


def repeated(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its hash is met again in its row, and whether it is the first of its kind there."""
    key = T.mix(hashes ^ T.mix(rows.astype(np.uint64) + T.U64(1)))
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(key), bool)
    lead[first] = True
    return n[inverse] > 1, lead


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each row of a slice."""
    _, _, ptr, words = T.words_of(data, at, T.NOT_SPACE, lower=False)
    n_words = np.diff(ptr)
    row_of_word = np.repeat(np.arange(len(n_words)), n_words)
    windows, first = T.shingle_hashes(words, ptr, WINDOW)
    again, _ = repeated(windows, row_of_word[first])
    hit = np.zeros(len(words), bool)
    for j in range(WINDOW):
        hit[first[again] + j] = True
    solid = T.NOT_SPACE[data]
    l_start, l_end, l_ptr = T.spans(data != 10, at)
    filled = np.concatenate([[0], np.cumsum(solid)])
    wordy = filled[l_end] > filled[l_start]
    line_rows = np.repeat(np.arange(len(n_words)), np.diff(l_ptr))[wordy]
    _, lead = repeated(T.span_hashes(data, l_start[wordy], l_end[wordy]), line_rows)
    return {
        "n_words": n_words,
        "word_chars": T.row_sums((solid & ((data & 0xC0) != 0x80)).astype(np.int64), at),
        "n_symbols": T.row_sums(SYMBOLS[data].astype(np.int64), at),
        "n_dup_lines": np.bincount(line_rows[~lead], minlength=len(n_words)).astype(np.int64),
        "n_repeat_words": T.row_sums(hit.astype(np.int64), ptr),
    }


def apply_rules(df: DataFrame, model: MarginModel, text: str = "text", min_quality: float = MIN_QUALITY) -> DataFrame:
    """``df`` with the base counts, ``base_failed``, ``quality`` (probability) and ``kept``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        got: dict[str, list] = {c: [] for c in (*COUNTS, "quality")}
        for _, _, data, at in T.slices(*T.utf8(T.column(batch, text))):
            for c, v in base_counts(data, at).items():
                got[c].append(v)
            got["quality"].append(shared.value.probabilities(data, at))
        v = {c: np.concatenate(x or [np.zeros(0)]) for c, x in got.items()}
        failed = (v["n_words"] < MIN_WORDS) | (100 * v["n_repeat_words"] > MAX_REPEAT_PERCENT * v["n_words"])
        return ([pa.array(v[c].astype(np.int64)) for c in COUNTS]
                + [pa.array(failed.astype(bool)), pa.array(v["quality"].astype(float)),
                   pa.array((~failed.astype(bool)) & (v["quality"] >= min_quality))])

    types = {c: "long" for c in COUNTS} | {"base_failed": "boolean", "quality": "double", "kept": "boolean"}
    return add_columns(df, types, run)
