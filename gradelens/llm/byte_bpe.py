"""Operator 9, byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file and the pre-split pattern are parameters; the file must exist on every executor.  Long
texts are cut before a space between two ASCII letters: under the pattern a run of letters ends before
that space and the space begins the next match, so the pieces' ids joined are the ids of the whole text.
A text without such a place is encoded whole.  Decoding joins raw bytes, so an id list that ends inside
a character loses nothing.

Defined results: NULL and empty texts have no ids and decode to no bytes.  A NULL id list decodes to no bytes;
an id outside the vocabulary ends the job.  Repeated rows give equal rows, empty tables empty results;
clashing input columns are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns
from gradelens.llm.token_counts import cut

#: Parameter: bytes from which a text is cut.
PIECE_BYTES = 1 << 17
SAFE = re.compile(rb"[A-Za-z](?= [A-Za-z])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoding of a rank file, loaded once per Python worker."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def encode_bytes(raw: bytes, enc, piece: int = PIECE_BYTES) -> list[int]:
    if len(raw) <= piece:
        return enc.encode_ordinary(raw.decode("utf-8"))
    out: list[int] = []
    for part in cut(raw, piece, SAFE):
        out += enc.encode_ordinary(part.decode("utf-8"))
    return out


def _rows(raw: np.ndarray, at: np.ndarray):
    for i in range(len(at) - 1):
        yield raw[at[i]:at[i + 1]].tobytes()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each text (array<int>)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoding(path, pattern)
        return [pa.array([encode_bytes(t, enc) for t in _rows(*T.utf8(T.column(batch, text)))], pa.list_(pa.int32()))]

    return add_columns(df, {out: "array<int>"}, run)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of each id list (binary)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoding(path, pattern)
        return [pa.array([enc.decode_bytes(x.as_py() or []) for x in T.column(batch, ids)], pa.binary())]

    return add_columns(df, {out: "binary"}, run)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one Arrow pass: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``token_ids``.

    The digests (lower-case hex) are of the decimal ids joined by one space and of the decoded bytes.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoding(path, pattern)
        names = decimals(enc.n_vocab)
        n, ids_sha, back_sha, kept = [], [], [], []
        for t in _rows(*T.utf8(T.column(batch, text))):
            ids = encode_bytes(t, enc)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            back_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            if keep_ids:
                kept.append(np.array(ids, np.int32))
        out = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
        return out + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])

    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return add_columns(df, new | ({"token_ids": "array<int>"} if keep_ids else {}), run)
