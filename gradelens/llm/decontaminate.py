"""Operator 6, benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Windows of ``n`` consecutive words of each benchmark text (a shorter text is one window) are hashed and made distinct.  Up to
``BLOCK_WINDOWS`` of them are one broadcast hash set; training texts are scanned against it window by window, and every hash hit is
verified on the words themselves.

Larger benchmarks stay a table.  A Bloom filter of all their window hashes, at most ``MAX_BITS`` bits, is broadcast instead; the one scan of
the documents counts words and puts out the few windows that it knows, with their words; these meet the table in an equi-join on length
and hash, the words decide, and the hits go back to their rows.  A filter that is too small for its windows costs shuffle, never a hit.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters.

Defined results: NULL and empty texts have no words, no hits and no items.  A benchmark row without an id counts
as the item with the empty id, one without words as nothing; rows of one id are one item.  An empty benchmark hits nothing.
Repeated documents give equal rows; clashing input columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns, map_batches
from gradelens.llm.bloom import contains, hash_filter, segments_for
from gradelens.llm.shared import stored

#: Parameters: words of a window, windows of a broadcast block (about 150 bytes each), filter bits per window of a larger set, most bits.
WINDOW = 10
BLOCK_WINDOWS = 100_000
BITS_PER_WINDOW, MAX_BITS = 16, 1 << 29
WINDOWS = "k int, h long, item string, words binary"


def _phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, k: int) -> bytes:
    """The ``k`` lower-cased words from word ``first`` on, joined by one space."""
    low = T.LOWER[data[starts[first]:ends[first + k - 1]]].tobytes()
    lo = starts[first]
    return b" ".join(low[starts[j] - lo:ends[j] - lo] for j in range(first, first + k))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct (k, h, item, words) of all windows of the benchmark texts."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for lo, _, data, at in T.slices(*T.utf8(b.column(1))):
                starts, ends, ptr, words = T.words_of(data, at, T.ALNUM)
                for r in range(len(at) - 1):
                    own = slice(ptr[r], ptr[r + 1])
                    k = min(n, ptr[r + 1] - ptr[r])
                    if k:
                        h, first = T.shingle_hashes(words[own], np.array([0, ptr[r + 1] - ptr[r]]), int(k))
                        rows += [(int(k), int(x), ids[lo + r], _phrases(data, starts, ends, int(ptr[r] + f), int(k)))
                                 for x, f in zip(h.view(np.int64), first)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.binary()))],
                names=["k", "h", "item", "words"])

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return map_batches(rows, run, WINDOWS).distinct()


@dataclass(frozen=True)
class Block:
    """One broadcast block: per window length the sorted hashes, each with its phrases and their items."""

    hashes: dict[int, np.ndarray]
    phrases: dict[int, dict[int, dict[bytes, list[str]]]]
    marks: dict[int, np.ndarray]

    @staticmethod
    def of(rows) -> "Block":
        phrases: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for k, h, item, words in rows:
            phrases.setdefault(k, {}).setdefault(h & T.MASK, {}).setdefault(bytes(words), []).append(item)
        hashes = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in phrases.items()}
        marks = {}
        for k, v in hashes.items():
            marks[k] = np.zeros(1 << 20, bool)
            marks[k][(v >> T.U64(44)).astype(np.int64)] = True
        return Block(hashes, phrases, marks)

    def hits(self, data, starts, ends, ptr, words):
        """(first word, length, items) of every verified window of a slice."""
        for k, known in self.hashes.items():
            h, first = T.shingle_hashes(words, ptr, k)
            near = np.flatnonzero(self.marks[k][(h >> T.U64(44)).astype(np.int64)])
            near = near[np.isin(h[near], known)]
            for j in near:
                items = self.phrases[k][int(h[j])].get(_phrases(data, starts, ends, int(first[j]), k))
                if items:
                    yield int(first[j]), k, items


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         n: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside benchmark windows), ``item_ids`` (sorted) and ``hit_spans``.

    ``hit_spans`` are the [start, end) byte ranges of maximal runs of hit words, flattened to start, end, start, ...
    """
    windows = stored(benchmark_windows(benchmark, item, item_text, n), "benchmark-windows")
    size = windows.count()
    if size > block_windows:
        return _scan_filtered(docs, windows, size, text)
    block = Block.of((r.k, r.h, r.item, r.words) for r in windows.toLocalIterator())
    return _scan_block(docs, docs.sparkSession.sparkContext.broadcast(block), text)


def _scan_block(docs: DataFrame, shared, text: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        block = shared.value
        n_words, n_hit, items, spans = [], [], [], []
        for _, _, data, at in T.slices(*T.utf8(T.column(batch, text))):
            starts, ends, ptr, words = T.words_of(data, at, T.ALNUM)
            hit = np.zeros(len(words), bool)
            got: dict[int, set[str]] = {}
            for first, k, found in block.hits(data, starts, ends, ptr, words):
                hit[first:first + k] = True
                got.setdefault(int(np.searchsorted(ptr, first, "right")) - 1, set()).update(found)
            n_words.append(np.diff(ptr))
            n_hit.append(T.row_sums(hit.astype(np.int64), ptr))
            for r in range(len(at) - 1):
                items.append(sorted(got.get(r, ())))
                flat = []
                if r in got:
                    a, b, _ = T.spans(hit[ptr[r]:ptr[r + 1]], np.array([0, ptr[r + 1] - ptr[r]]))
                    for x, y in zip(a, b):
                        flat += [int(starts[ptr[r] + x] - at[r]), int(ends[ptr[r] + y - 1] - at[r])]
                spans.append(flat)
        none = np.zeros(0, np.int64)
        return [pa.array(np.concatenate(n_words or [none])), pa.array(np.concatenate(n_hit or [none])),
                pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]

    return add_columns(docs, {"n_words": "long", "n_hit": "long", "item_ids": "array<string>", "hit_spans": "array<long>"}, run)


def _scan_filtered(docs: DataFrame, windows: DataFrame, size: int, text: str) -> DataFrame:
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())       # at most as many as words of a window
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(windows.select("h"), segments_for(size, BITS_PER_WINDOW, MAX_BITS)))
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    row, found, hits = mark + "row", mark + "suspects", mark + "hits"

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n_words, rows = [], []
        for _, _, data, at in T.slices(*T.utf8(T.column(batch, text))):
            starts, ends, ptr, words = T.words_of(data, at, T.ALNUM)
            n_words.append(np.diff(ptr))
            own: list[list[dict]] = [[] for _ in range(len(at) - 1)]
            for k in lengths:
                h, first = T.shingle_hashes(words, ptr, k)
                for j in np.flatnonzero(contains(shared.value, h)).tolist():
                    f = int(first[j])
                    r = int(np.searchsorted(ptr, f, "right")) - 1
                    own[r].append({"k": k, "h": int(h[j].view(np.int64)), "at": f - int(ptr[r]), "lo": int(starts[f] - at[r]), "hi": int(ends[f + k - 1] - at[r]),
                                   "words": _phrases(data, starts, ends, f, k)})
            rows += own
        kind = pa.struct([("k", pa.int32()), ("h", pa.int64()), ("at", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("words", pa.binary())])
        return [pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)])), pa.array(rows, pa.list_(kind))]

    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "item_ids", "hit_spans")]
    numbered = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(row, F.monotonically_increasing_id())
    scanned = stored(add_columns(numbered, {"n_words": "long", found: "array<struct<k:int,h:bigint,at:bigint,lo:bigint,hi:bigint,words:binary>>"}, run), "scanned-documents")
    suspects = scanned.select(row, F.explode(found).alias("s")).select(row, "s.*")
    met = (suspects.join(windows.withColumnRenamed("words", "own"), ["k", "h"]).where(F.col("words") == F.col("own"))
           .groupBy(row).agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.sort_array(F.collect_set(F.struct("at", "k", "lo", "hi"))).alias(hits)))

    def merge(batch: pa.RecordBatch) -> list[pa.Array]:
        n_hit, spans = [], []
        for got in T.column(batch, hits):
            total, flat, end = 0, [], -1
            for w in got.as_py() or ():
                if w["at"] > end:                     # a word lies between: a new run
                    flat += [w["lo"], w["hi"]]
                    total += w["k"]
                    end = w["at"] + w["k"]
                elif w["at"] + w["k"] > end:
                    flat[-1] = w["hi"]
                    total += w["at"] + w["k"] - end
                    end = w["at"] + w["k"]
            n_hit.append(total)
            spans.append(flat)
        return [pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int64()))]

    joined = scanned.drop(found).join(met, row, "left").drop(row)
    out = add_columns(joined, {"n_hit": "long", "hit_spans": "array<long>"}, merge)
    return out.select(*kept, "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "hit_spans")


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """A scanned frame with the hit spans cut out of its texts (NULL texts stay NULL)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t, flat in zip(T.column(batch, text).to_pylist(), T.column(batch, "hit_spans").to_pylist()):
            if t is not None and flat:
                raw, keep, lo = t.encode(), [], 0
                for s, e in zip(flat[::2], flat[1::2]):
                    keep.append(raw[lo:s])
                    lo = e
                t = b"".join([*keep, raw[lo:]]).decode()
            out.append(t)
        return [pa.array(out, pa.string())]

    names = scanned.columns
    return add_columns(scanned, {text: "string"}, run).select(*names)


def remove_documents(scanned: DataFrame) -> DataFrame:
    """The rows of a scanned frame without a hit."""
    return scanned.where(F.col("n_hit") == 0)
