"""Vectorised text helpers for Arrow batches: byte views, word spans, 64-bit word hashes.

A text column is seen as one UTF-8 byte buffer with row offsets.  Work goes
slice by slice (whole rows, about ``SLICE`` bytes), so memory inside a task is
bounded by the slice or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
MASK = (1 << 64) - 1
U64 = np.uint64

# Byte classes of the contracts.  ASCII_SPACE is [\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def byte_table(letters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(letters)] = True
    return out


#: Bytes of words split at ASCII white space, and of lower-cased letter/digit words (non-ASCII counts as a letter).
NOT_SPACE = ~byte_table(ASCII_SPACE)
ALNUM = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
#: A-Z lower-cased, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64); a bijection, so equal inputs alone give equal outputs."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One fixed random 64-bit value per byte, and the odd base of the polynomial hash with its inverse mod 2^64.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64 (kept between calls, grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, base, U64)]))
        if size <= SLICE:
            _powers[base] = have
    return have[:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; NULL is the empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32) if offs is not None and offs.size else np.zeros(1, np.int32)
    at = at[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(raw: np.ndarray, at: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows of about ``size`` bytes."""
    rows, lo = len(at) - 1, 0
    while lo < rows:
        hi = int(np.searchsorted(at, at[lo] + size, "right")) - 1
        hi = min(rows, max(lo + 1, hi))
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def pieces(raw: np.ndarray, at: np.ndarray, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, bytes, offsets from 0): runs of whole rows of about ``size`` bytes; longer rows go in several pieces
    that end before ASCII white space, so no word is cut (a longer word stays whole)."""
    for lo, hi, data, cuts in slices(raw, at, size):
        if hi - lo > 1 or len(data) <= 2 * size:
            yield np.arange(lo, hi), data, cuts
            continue
        begin = 0
        while begin < len(data):
            end = begin + size
            while end < len(data):
                gap = np.flatnonzero(~NOT_SPACE[data[end:end + size]])
                if len(gap):
                    end += int(gap[0])
                    break
                end += size
            end = min(end, len(data))
            yield np.array([lo]), data[begin:end], np.array([0, end - begin])
            begin = end


def spans(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay within a row: (starts, ends, pointer of each row's first run)."""
    n = len(kind)
    begins, stops = kind.copy(), kind.copy()
    if n:
        begins[1:] &= ~kind[:-1]
        stops[:-1] &= ~kind[1:]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = kind[first]
        last = at[1:][at[:-1] < at[1:]] - 1
        stops[last] = kind[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes (polynomial over random byte codes, mod 2^64, then mixed)."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data))[starts] + (ends - starts).astype(U64))


def shingle_hashes(words: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``k`` consecutive words within a row, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    row_end = np.repeat(ptr[1:], np.diff(ptr))
    first = np.flatnonzero(np.arange(n) + k <= row_end[:n])
    out = np.full(len(first), k, U64)
    for j in range(k):
        out = mix(out * U64(BASE) + words[first + j])
    return out, first


def words_of(data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """(starts, ends, pointer, hashes) of the words of a slice; A-Z count as a-z with ``lower``."""
    starts, ends, ptr = spans(kind[data], at)
    return starts, ends, ptr, span_hashes(LOWER[data] if lower else data, starts, ends)


def row_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of each row's values (rows may be empty)."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64),
                            np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]
