"""Operator 8, token counts: batch encoding inside Arrow functions that returns lengths only.

The tokenizer file is a parameter (its path must exist on every executor): ``.json`` for the
tokenizers library, ``.model`` for sentencepiece.  Texts are split at boundaries that no token crosses, and lengths of pieces add
up to the length of the whole text:

- A tokenizer whose pre-tokenizer drops white space has no token over ASCII white space, and its normaliser joins nothing across
  it (a space is a starter that composes with nothing).  Texts are split there; the distinct words of a slice (64-bit hashes) are
  encoded once, in batches of about ``BATCH_BYTES``, and a worker remembers the lengths of ``REMEMBERED`` words.
- Other ``.json`` tokenizers: long texts are cut at a space or line break between two ASCII letters or digits.
- Sentencepiece joins spaces to the words after them, so its texts are encoded whole, as is a text without a safe boundary.

Batches are balanced by bytes, so a batch's memory does not follow the row count; long texts go in pieces of about ``PIECE_BYTES``.

Defined results: NULL and empty texts have 0 bytes and 0 tokens.  Strings of special tokens inside a text are handled as the
library's default.  Repeated rows give equal rows, empty tables empty results; clashing input columns are replaced.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns

#: Parameters: bytes of a batch, bytes from which a text is cut, words whose lengths a worker keeps, tokens beyond which a text is over the limit.
BATCH_BYTES = 1 << 18
PIECE_BYTES = 1 << 16
REMEMBERED = 1 << 20
LIMIT = 2048
SAFE = re.compile(rb"[A-Za-z0-9](?=[ \n][A-Za-z0-9])")


def cut(raw: bytes, size: int = PIECE_BYTES, boundary: re.Pattern = SAFE) -> list[bytes]:
    """``raw`` in pieces of at least ``size`` bytes that end at safe boundaries."""
    out, lo = [], 0
    while len(raw) - lo > size:
        m = boundary.search(raw, lo + size)
        if m is None:
            break
        out.append(raw[lo:m.end()])
        lo = m.end()
    return [*out, raw[lo:]]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(path)
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path)
    raise ValueError(f"no tokenizer library for {path}")


def counter(path: str):
    """A function from a batch of texts to their token counts."""
    tok = tokenizer(path)
    if path.endswith(".json"):
        return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return lambda texts: [len(e) for e in tok.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=4)
def splits_words(path: str) -> bool:
    """Whether a tokenizer drops white space before any merge, so that words around it are encoded on their own."""
    if not path.endswith(".json") or tokenizer(path).pre_tokenizer is None:
        return False
    probe = "a  b\n c\t1 \r\x0b\x0cd. (e) "
    pieces = tokenizer(path).pre_tokenizer.pre_tokenize_str(probe)
    covered = sorted(i for _, (lo, hi) in pieces for i in range(lo, hi))
    return covered == [i for i, c in enumerate(probe) if not c.isspace()]


@functools.lru_cache(maxsize=4)
def lengths_known(path: str) -> dict[int, int]:
    """Token counts of words by hash, kept by the worker."""
    return {}


def batched_counts(texts, count, batch: int) -> list[int]:
    """``count`` over ``texts`` (bytes) in batches of about ``batch`` bytes."""
    out: list[int] = []
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t.decode("utf-8"))
        size += len(t)
        if size >= batch:
            out += count(held)
            held, size = [], 0
    return out + (list(count(held)) if held else [])


def word_lengths(raw: np.ndarray, at: np.ndarray, path: str, batch: int) -> np.ndarray:
    """Tokens of each row, word by word, where white space is never in a token."""
    count, known = counter(path), lengths_known(path)
    out = np.zeros(len(at) - 1, np.int64)
    for rows, data, cuts in T.pieces(raw, at):
        starts, ends, ptr, h = T.words_of(data, cuts, T.NOT_SPACE, lower=False)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = range(len(keys))
        words = (data[starts[first[i]]:ends[first[i]]].tobytes() for i in new)
        known.update(zip([keys[i] for i in new], batched_counts(words, count, batch)))
        n = np.fromiter((known[k] for k in keys), np.int64, len(keys))
        np.add.at(out, rows, T.row_sums(n[inverse], ptr))
    return out


def token_lengths(raw: np.ndarray, at: np.ndarray, path: str, piece: int = PIECE_BYTES, batch: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each row's text, counted in batches of about ``batch`` bytes."""
    if splits_words(path):
        return word_lengths(raw, at, path, batch)
    whole = path.endswith(".model")     # a leading space is not neutral there
    out, owner = np.zeros(len(at) - 1, np.int64), []

    def parts():
        for i in range(len(at) - 1):
            data = raw[at[i]:at[i + 1]].tobytes()
            if data:
                for part in [data] if whole or len(data) <= piece else cut(data, piece):
                    owner.append(i)
                    yield part

    n = batched_counts(parts(), counter(path), batch)
    np.add.at(out, owner, n)
    return out


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, at = T.utf8(T.column(batch, text))
        n = token_lengths(raw, at, path)
        return [pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)]

    return add_columns(df, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, run)
