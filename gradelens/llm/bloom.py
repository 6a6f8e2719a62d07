"""A Bloom filter over 64-bit hashes, split into segments of a fixed number of bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import map_batches

SEGMENT_BITS = 1 << 20
PROBES = 4


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> T.U64(40)).astype(np.int64) % segments


def probes(h: np.ndarray) -> list[np.ndarray]:
    """Bit positions of each hash within its segment."""
    a, b = T.mix(h), T.mix(h ^ T.U64(T.BASE)) | T.U64(1)
    return [((a + T.U64(j) * b) >> T.U64(30)).astype(np.int64) % SEGMENT_BITS for j in range(PROBES)]


def contains(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter (segments x packed bytes) knows each hash; never False for one that was put in."""
    s = segment_of(h, len(table))
    known = np.ones(len(h), bool)
    for p in probes(h):
        known &= (table[s, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return known


def segments_for(items: int, bits_each: int, max_bits: int) -> int:
    return int(min(max_bits, max(SEGMENT_BITS, items * bits_each)) // SEGMENT_BITS)


def packed_row(segment: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                                      names=["segment", "bits"])


def gathered(rows: DataFrame, segments: int) -> np.ndarray:
    """Rows (segment, packed bits) as one table on the driver; the filter's bound in bits bounds it."""
    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in rows.toLocalIterator():
        out[r.segment] = np.frombuffer(r.bits, np.uint8)
    return out


def hash_filter(hashes: DataFrame, segments: int) -> np.ndarray:
    """A filter of all values of the one long column of ``hashes``."""

    def run(batches):
        own: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = segment_of(h, segments)
            for s in np.unique(at):
                bits = own.setdefault(int(s), np.zeros(SEGMENT_BITS, bool))
                for p in probes(h[at == s]):
                    bits[p] = True
        for s, bits in own.items():
            yield packed_row(s, bits)

    # bigint arithmetic of segment_of: an unsigned shift, then the remainder
    part = F.shiftrightunsigned(F.col(hashes.columns[0]), 40) % segments
    rows = map_batches(hashes.repartition(segments, part), run, "segment int, bits binary")
    return gathered(rows, segments)
