"""Operator 3, line dedup with two Bloom filters.

1. Every map task hashes the long lines of its documents and ships 8-byte hashes, packed per filter segment:
   those met in one document and those met in several.
2. One pass per segment inserts them into the once-seen filter; a hash already there goes into the twice-seen
   filter.  A segment is a fixed number of bits, so a task's memory does not follow the data.
3. The twice-seen filter (at most ``MAX_BITS`` bits) is broadcast.  Only lines it knows are suspected repeats; a
   128-bit digest of their key and their document id shuffle for the exact count of documents and the choice of the
   document that keeps the line.
4. Documents meet the digests they lose and drop those lines.

A Bloom filter has no false negatives, so no repeat is missed.  False positives cost shuffle, never a line: beyond
``MAX_BITS / BITS_PER_LINE`` distinct lines the share of suspects grows.

Key of a line: stripped of ASCII white space at both ends, A-Z lower-cased.  Keys under ``min_chars`` code points are
never dropped.  A key found in ``min_docs`` documents or more is kept by the largest document id alone.

Defined results: NULL and empty texts are one empty line.  Documents without an id count as no document and lose no
line.  Rows that share an id are one document.  Repeated lines of the keeping document all stay.  Empty
tables give empty results; clashing input columns are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns, map_batches
from gradelens.llm.bloom import SEGMENT_BITS, contains, gathered, packed_row, probes, segment_of, segments_for
from gradelens.llm.shared import stored

#: Parameters: shortest key, documents from which a key is a repeat, filter bits per line, most bits of the filter.
MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_LINE = 12
MAX_BITS = 1 << 29


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short."""
    key = line.strip(T.ASCII_SPACE).lower()      # bytes.lower() changes A-Z alone
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars):
        return None
    return key


def keyed_lines(raw: np.ndarray, at: np.ndarray, min_chars: int):
    """(row, distinct keys of its text) for each row with a key."""
    for i in range(len(at) - 1):
        if at[i + 1] - at[i] >= min_chars:
            keys = {k for line in raw[at[i]:at[i + 1]].tobytes().split(b"\n") if (k := line_key(line, min_chars)) is not None}
            if keys:
                yield i, keys


def line_hashes(docs: DataFrame, id_col: str, text: str, segments: int, min_chars: int) -> DataFrame:
    """(segment, once, twice): packed hashes of keys that one Arrow batch met in one, and in several, documents."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            seen: dict[int, object] = {}
            many: set[int] = set()
            for i, keys in keyed_lines(*T.utf8(b.column(1)), min_chars):
                for k in keys:
                    h = xxhash.xxh3_64_intdigest(k)
                    if seen.setdefault(h, ids[i]) != ids[i]:
                        many.add(h)
            once = np.fromiter((h for h in seen if h not in many), np.uint64)
            twice = np.fromiter(many, np.uint64, len(many))
            s1, s2 = segment_of(once, segments), segment_of(twice, segments)
            o1, o2 = np.argsort(s1, kind="stable"), np.argsort(s2, kind="stable")
            present = np.union1d(s1, s2)
            cut = [np.searchsorted(s[o], [present, present + 1]) for s, o in ((s1, o1), (s2, o2))]
            packed = [[v[o][lo:hi].tobytes() for lo, hi in zip(*c)] for v, o, c in ((once, o1, cut[0]), (twice, o2, cut[1]))]
            yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *(pa.array(p, pa.binary()) for p in packed)],
                                             names=["segment", "once", "twice"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    return map_batches(rows, run, "segment int, once binary, twice binary")


def twice_seen(hashes: DataFrame, segments: int) -> np.ndarray:
    """The twice-seen filter as packed bits, segment after segment."""

    def run(batches):
        first: dict[int, np.ndarray] = {}
        second: dict[int, np.ndarray] = {}
        for b in batches:
            for s, one, two in zip(*(c.to_pylist() for c in b.columns)):
                seen = first.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                again = second.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                for p in probes(np.frombuffer(two, np.uint64)):
                    seen[p] = True
                    again[p] = True
                h = np.frombuffer(one, np.uint64)
                at = probes(h)
                known = np.logical_and.reduce([seen[p] for p in at]) if len(h) else np.zeros(0, bool)
                for p in at:
                    again[p[known]] = True
                    seen[p] = True
        for s, bits in second.items():
            yield packed_row(s, bits)

    return gathered(map_batches(hashes.repartition(segments, "segment"), run, "segment int, bits binary"), segments)


def suspects(docs: DataFrame, id_col: str, text: str, bits: np.ndarray, min_chars: int) -> DataFrame:
    """(id, digest) of each distinct key of a document that the twice-seen filter knows."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for b in batches:
            rows: list[int] = []
            keys: list[bytes] = []
            for i, own in keyed_lines(*T.utf8(b.column(1)), min_chars):
                rows += [i] * len(own)
                keys += own
            h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
            at = np.flatnonzero(contains(shared.value, h))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.array(rows, np.int64)[at])), pa.array([digest(keys[j]) for j in at], pa.binary())],
                names=["i", "digest"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text).alias("t"))
    return map_batches(rows, run, f"i {kind.simpleString()}, digest binary")


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def filter_segments(docs: DataFrame, text: str) -> int:
    """Segments of a filter sized by the bytes of all texts (a long line has 40 code points at least), within ``MAX_BITS``."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return segments_for(size // (4 * MIN_CHARS), BITS_PER_LINE, MAX_BITS)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` (the lines that stay, joined by a line break)."""
    segments = filter_segments(docs, text)
    bits = twice_seen(line_hashes(docs, id_col, text, segments, min_chars), segments)
    found = stored(suspects(docs, id_col, text, bits, min_chars), "line-suspects")
    repeats = stored(found.groupBy("digest").agg(F.count_distinct("i").alias("n"), F.max("i").alias("keeper"))
                     .where(F.col("n") >= min_docs).select("digest", "keeper"), "line-repeats")
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    own, gone_ = mark + "id", mark + "lost"
    lost = (found.join(repeats, "digest").where(F.col("i") < F.col("keeper"))
            .groupBy(F.col("i").alias(own)).agg(F.collect_set("digest").alias(gone_)))
    joined = docs.join(lost, docs[id_col] == lost[own], "left").drop(own)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        gone = T.column(batch, gone_)
        n, dropped, kept = [], [], []
        for i, t in enumerate(T.column(batch, text)):
            lines = (t.as_py() or "").encode().split(b"\n")
            stay = lines
            if gone[i].is_valid:
                drop = set(gone[i].as_py())
                stay = [x for x in lines if (k := line_key(x, min_chars)) is None or digest(k) not in drop]
            n.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode())
        return [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]

    return add_columns(joined, {"n_lines": "long", "n_dropped": "long", "kept_text": "string"}, run).drop(gone_)
