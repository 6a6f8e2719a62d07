"""Operator 13, cross-tokenizer alignment by lockstep vectorised merging.

Tokenizer A encodes a space and the text, tokenizer B the text, before which it puts a space itself.  The byte offsets at which their
tokens end are merged for all texts of a slice at once: one NumPy state vector holds each text's place in A and in B, every step
compares the two ends, emits a link and a cut where they are equal, advances the pointer that is behind (both after a link) and drops
finished texts from the state.  Long texts stand in the state by several lanes of ``LANE`` A tokens, so steps do not follow the longest text.

1. ``align``: counts of tokens, groups between cuts and links of each text, the digest of its groups, and its distinct linked id pairs.
2. ``link_counts``: how many links of all texts hold an id pair, combined in each task before the shuffle.
3. ``link_scores``: a text's links whose pair is the most frequent one of its B id, and the sum of their counts.  The pairs of high
   counts, at most ``FREQUENT``, are broadcast (24 bytes each); the others, none of which is on many links, meet their texts in an equi-join.

Long texts are cut between two ASCII letters around one space: A begins a token with that space and B's dummy prefix stands for it,
so both tokenizers have an end there and the pieces' groups are the text's.  Pieces, not texts, bound the memory of a task, except for
a text without such a place.

Defined results: NULL and empty texts, and texts whose joined token bytes differ from a space and the text (characters that a
tokenizer rewrites), have no tokens: zeros, no pairs, an empty ``groups_sha256``.  Every token has a byte at least, so each end is that
of one token of a side, and groups and links are equally many.  Repeated rows each count.  Empty tables give empty results; clashing
input columns are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns, map_batches
from gradelens.llm.shared import stored

#: Parameters: bytes from which a text is cut, bytes of a slice, A tokens of a lane, ids that a worker remembers, pairs that are broadcast.
PIECE_BYTES = 1 << 16
SLICE = 1 << 20
LANE = 64
REMEMBERED = 1 << 21
FREQUENT = 1 << 20
GAP = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Parquet option: link pairs are few distinct values, so their dictionary may be larger than the default.
DICTIONARY = {"parquet.dictionary.page.size": 16 << 20}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer with the bytes of its entries: ``data[start[i]:start[i] + size[i]]``."""

    encode: Callable[[list[str]], list[list[int]]]
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    cuts: bool = True

    @property
    def n(self) -> int:
        return len(self.size)

    @staticmethod
    def of(encode, entries: list[bytes], cuts: bool = True) -> "Vocabulary":
        size = np.array([len(e) for e in entries], np.int64)
        return Vocabulary(encode, np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size, cuts)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens one after another."""
        size = self.size[ids]
        first = np.cumsum(size) - size
        return self.data[np.repeat(self.start[ids] - first, size) + np.arange(int(size.sum()))]


def byte_alphabet() -> dict[str, int]:
    """Character → byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def byte_level(path: str, pattern: str | None = None) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library, special strings as plain text.

    Where the file's ids are its merge ranks and its pre-split is the plain byte-level one, ``pattern`` lets the tiktoken library
    encode the same ids several times faster; any other file is encoded by the tokenizers library.
    """
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, alphabet = spec["model"], byte_alphabet()
    special = {t["id"] for t in spec["added_tokens"]}
    n = 1 + max([*model["vocab"].values(), *special])
    entries = [b"\x00"] * n
    for token, i in model["vocab"].items():
        entries[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    ranks = {e: i for i, e in enumerate(entries) if i not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    rank_of = [ranks[bytes(alphabet[c] for c in a + b)] for a, b in merges]
    split = spec["pre_tokenizer"] or {}
    plain = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec["normalizer"] is None
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
             and all(x < y for x, y in zip(rank_of, rank_of[1:])) and len(ranks) == 256 + len(merges))
    if pattern and plain:
        import tiktoken
        own = tiktoken.Encoding("ranks-of-json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Vocabulary.of(lambda texts: [own.encode_ordinary(t) for t in texts], entries)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return Vocabulary.of(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], entries, plain)


@functools.lru_cache(maxsize=4)
def piece_level(path: str) -> Vocabulary:
    """A sentencepiece file; a piece's bytes are its UTF-8 with U+2581 as a space, or the byte that it names."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    entries = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    inner = any("▁" in p.lstrip("▁") for p in names)       # a piece over a word's end: texts are never cut
    return Vocabulary.of(lambda texts: sp.encode(texts, num_threads=1), entries, not inner and sp.encode("ab cd") == sp.encode("ab") + sp.encode("cd"))


def lockstep(a_end: np.ndarray, b_end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every pair with one end.  Ends ascend over all texts; ``first`` are the A tokens at which lanes begin."""
    stop_a = np.append(first[1:], len(a_end))
    before = np.where(first > 0, a_end[first - 1], 0)
    i, j = first.copy(), np.searchsorted(b_end, before, "right")
    stop_b = np.append(j[1:], len(b_end))
    alive = (i < stop_a) & (j < stop_b)
    found_a, found_b = [], []
    while True:
        if not alive.all():
            i, j, stop_a, stop_b = i[alive], j[alive], stop_a[alive], stop_b[alive]
        if not len(i):
            break
        x, y = a_end[i], b_end[j]
        link = x == y
        found_a.append(i[link])
        found_b.append(j[link])
        i = i + (x <= y)
        j = j + (y <= x)
        alive = (i < stop_a) & (j < stop_b)
    none = np.zeros(0, np.int64)
    a, b = np.concatenate(found_a or [none]), np.concatenate(found_b or [none])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


LETTER = T.byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Encoder:
    """Both tokenizers over the distinct parts of texts, which a worker remembers until they have ``REMEMBERED`` ids.

    Parts lie around the single spaces between two ASCII letters; each is encoded by A with its space and by B without.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.sides, self.cuts = (a, b), a.cuts and b.cuts
        self.forget()

    def forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids = [np.zeros(0, np.int64)] * 2
        self.end = [np.zeros(1, np.int64)] * 2

    def learn(self, keys: list[int], parts: list[str]) -> None:
        for k, texts in enumerate(([" " + p for p in parts], parts)):
            got = self.sides[k].encode(texts)
            n = np.fromiter(map(len, got), np.int64, len(got))
            more = np.fromiter(itertools.chain.from_iterable(got), np.int64, int(n.sum()))
            self.ids[k] = np.concatenate([self.ids[k], more])
            self.end[k] = np.concatenate([self.end[k], self.end[k][-1] + np.cumsum(n)])
        self.slots.update(zip(keys, range(len(self.slots), len(self.slots) + len(keys))))

    def parts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, pointer of each text's first part)."""
        gap = np.zeros(0, np.int64)
        if self.cuts and len(data) > 2:
            inside = data[1:-1] == 32
            inside &= LETTER[data[:-2]] & LETTER[data[2:]]
            gap = np.flatnonzero(inside) + 1
            row = np.searchsorted(at, gap, "right")
            gap = gap[(gap > at[row - 1]) & (gap + 1 < at[row])]
        filled = at[1:] > at[:-1]
        starts = np.sort(np.concatenate([at[:-1][filled], gap + 1]))
        ends = np.sort(np.concatenate([at[1:][filled], gap]))
        return starts, ends, np.searchsorted(starts, at)

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side (ids one after another, pointer of each text's first)."""
        starts, ends, ptr = self.parts(data, at)
        distinct, first, inverse = np.unique(T.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if max(map(len, self.ids)) > REMEMBERED:
            self.forget()
        new = [i for i, k in enumerate(keys) if k not in self.slots]
        lo, hi = starts[first], ends[first]
        self.learn([keys[i] for i in new], [data[lo[i]:hi[i]].tobytes().decode("utf-8") for i in new])
        slot = np.fromiter((self.slots[k] for k in keys), np.int64, len(keys))[inverse]
        out = []
        for ids, end in zip(self.ids, self.end):
            n = end[slot + 1] - end[slot]
            total = np.concatenate([[0], np.cumsum(n)])
            out.append((ids[np.repeat(end[slot] - total[:-1], n) + np.arange(total[-1])], total[ptr]))
        return out


@functools.lru_cache(maxsize=2)
def encoder(a_path: str, b_path: str, pattern: str | None) -> Encoder:
    return Encoder(byte_level(a_path, pattern), piece_level(b_path))


@functools.lru_cache(maxsize=8)
def named(n: int, end: str) -> np.ndarray:
    return np.array([f"{i}{end}" for i in range(n)], object)


@dataclass
class Aligned:
    """The alignment of the texts of a slice: counts of each, its groups as text, its distinct pairs with their times."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    times: np.ndarray
    ptr: np.ndarray


def aligned(texts: list[bytes], both: Encoder) -> Aligned:
    rows, (a, b) = len(texts), both.sides
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    (ia, pa_), (ib, pb) = both.encode(np.frombuffer(b"".join(texts), np.uint8), at)
    want = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
    at = at + np.arange(rows + 1)
    size = np.diff(at)
    valid = size > 1
    for v, ids, ptr in ((a, ia, pa_), (b, ib, pb)):
        got = T.row_sums(v.size[ids], ptr) == size
        if got.all():
            valid &= T.row_sums((v.joined(ids) == want).astype(np.int64), at) == size
        else:
            valid &= np.array([ok and v.joined(ids[ptr[r]:ptr[r + 1]]).tobytes() == want[at[r]:at[r + 1]].tobytes() for r, ok in enumerate(got)], bool)
    n_a, n_b = (np.where(valid, np.diff(p), 0) for p in (pa_, pb))
    if not valid.all():      # what is left out has no tokens, and takes no bytes below
        ia, ib = (ids[np.repeat(valid, np.diff(p))] for ids, p in ((ia, pa_), (ib, pb)))
        pa_, pb = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    lanes = -(-n_a // LANE)
    first = np.repeat(pa_[:-1], lanes) + (np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    la, lb = lockstep(np.cumsum(a.size[ia]), np.cumsum(b.size[ib]), first)
    cut = np.searchsorted(la, pa_)
    # the groups as text: A ids, then B ids of each group, by (group, side)
    links = [np.zeros(len(ids), np.int64) for ids in (ia, ib)]
    for mark, x in zip(links, (la, lb)):
        mark[x] = 1
    side = [2 * (np.cumsum(mark) - mark) + k for k, mark in enumerate(links)]
    order = np.argsort(np.concatenate(side), kind="stable")
    words = np.concatenate([named(a.n, ",")[ia], named(b.n, ",")[ib]])
    words[la] = named(a.n, "|")[ia[la]]
    words[len(ia) + lb] = named(b.n, ";")[ib[lb]]
    merged, place = words[order].tolist(), (pa_ + pb).tolist()
    groups = ["".join(merged[lo:hi])[:-1] for lo, hi in zip(place, place[1:])]
    # distinct pairs of each text
    span = a.n * b.n
    key = np.sort(np.repeat(np.arange(rows), np.diff(cut)) * span + ia[la] * b.n + ib[lb])
    new = np.flatnonzero(np.diff(key, prepend=-1))
    return Aligned(valid, n_a, n_b, np.diff(cut), groups, key[new] % span, np.diff(np.append(new, len(key))),
                   np.searchsorted(key[new], np.arange(rows + 1) * span))


def pieces_of(raw: np.ndarray, at: np.ndarray, cuts: bool, size: int) -> Iterator[tuple[int, bytes]]:
    """(row, piece) of every text that is not empty, in order."""
    for i in range(len(at) - 1):
        t, lo = raw[at[i]:at[i + 1]].tobytes(), 0
        while cuts and len(t) - lo > size:
            m = GAP.search(t, lo + size)
            if m is None:
                break
            yield i, t[lo:m.start()]
            lo = m.end()
        if t:
            yield i, t[lo:]


class Rows:
    """Results of the rows of a batch, put together piece by piece."""

    def __init__(self, n: int, keep: bool):
        self.valid = np.ones(n, bool)
        self.n_a, self.n_b, self.n_links = (np.zeros(n, np.int64) for _ in range(3))
        self.digest: list = [None] * n
        self.groups: list[list[str]] = [[] for _ in range(n)] if keep else []
        self.pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]

    def add(self, rows: np.ndarray, got: Aligned) -> None:
        np.logical_and.at(self.valid, rows, got.valid)
        for total, part in ((self.n_a, got.n_a), (self.n_b, got.n_b), (self.n_links, got.n_links)):
            np.add.at(total, rows, part)
        for k, r in enumerate(rows.tolist()):
            part = got.groups[k]
            if self.digest[r] is None:
                self.digest[r] = hashlib.sha256(part.encode())
            else:
                self.digest[r].update(b";" + part.encode())
            if self.groups:
                self.groups[r].append(part)
            own = slice(got.ptr[k], got.ptr[k + 1])
            held = self.pairs[r]
            held.append((got.pairs[own], got.times[own]))
            if len(held) > 1 and sum(len(p) for p, _ in held[1:]) > len(held[0][0]) + 65536:
                self.pairs[r] = [self.distinct(held)]

    @staticmethod
    def distinct(held) -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1:
            return held[0]
        pairs, inverse = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(inverse, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)

    def arrays(self) -> list[pa.Array]:
        ok = self.valid & (self.n_links > 0)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        merged = [self.distinct(h) if k and h else none for k, h in zip(ok.tolist(), self.pairs)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in merged])]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *(m[k] for m in merged)]), kind))
                 for k, kind in ((0, pa.int64()), (1, pa.int32()))]
        counts = [pa.array(np.where(ok, v, 0)) for v in (self.n_a, self.n_b, self.n_links, self.n_links)]
        digests = pa.array([d.hexdigest() if k else "" for k, d in zip(ok.tolist(), self.digest)], pa.string())
        kept = [pa.array([";".join(g) if k else "" for k, g in zip(ok.tolist(), self.groups)], pa.string())] if self.groups or not len(ok) else []
        return [*counts, digests, *lists, *kept]


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", pattern: str | None = None, keep_groups: bool = False,
          piece: int = PIECE_BYTES) -> DataFrame:
    """``df`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and the distinct linked ``pairs`` (A id * B's size + B id)
    with their ``times``; with ``keep_groups`` also ``groups`` as text (``a1,a2|b1;a3|b2,b3``)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        both = encoder(a_path, b_path, pattern)
        raw, at = T.utf8(T.column(batch, text))
        out = Rows(len(batch), keep_groups)
        rows: list[int] = []
        texts: list[bytes] = []
        size = 0
        for r, t in pieces_of(raw, at, both.cuts, piece):
            rows.append(r)
            texts.append(t)
            size += len(t)
            if size >= SLICE:
                out.add(np.array(rows), aligned(texts, both))
                rows, texts, size = [], [], 0
        if rows:
            out.add(np.array(rows), aligned(texts, both))
        got = out.arrays()
        return got if not keep_groups or len(got) == 8 else [*got, pa.array([""] * len(batch), pa.string())]

    new = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<bigint>", "times": "array<int>"}
    return add_columns(df, new | ({"groups": "string"} if keep_groups else {}), run)


def lists(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, pointers from 0) of a list column without NULLs."""
    at = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(np.int64), at - at[0]


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): links of all texts that hold an id pair."""

    def run(batches):
        for b in batches:
            pairs, inverse = np.unique(lists(b.column(0))[0], return_inverse=True)
            n = np.bincount(inverse, lists(b.column(1))[0], len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    return map_batches(rows.select("pairs", "times"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(counts: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): whether no other pair of its B id is on more links.  A B id has at most one pair for each A id."""
    of_b = Window.partitionBy(F.pmod("pair", F.lit(n_b)))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def frequent(marked: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs of high counts, at most ``most``; the other ones, or None): split at a power of 2^(1/4) of the counts."""
    level = F.floor(F.log2("n") * 4)
    sizes = sorted(((r.level, r["count"]) for r in marked.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = None, 0
    for at, n in sizes:
        if held + n > most:
            break
        least, held = at, held + n
    if held == sum(n for _, n in sizes):
        return marked, None
    return (marked.where(level >= least) if least is not None else marked.limit(0)), (marked.where(level < least) if least is not None else marked)


def link_scores(rows: DataFrame, marked: DataFrame, most: int = FREQUENT) -> DataFrame:
    """Aligned ``rows`` with ``n_best`` (links whose pair is the most frequent of its B id) and ``count_sum`` (of the links' pair counts).

    ``marked`` is ``best_pairs`` of all rows.  The sums of the broadcast pairs are made in place; with more pairs than ``most``, what
    is left of each text is joined with its pairs by rows of (row, pair, times).
    """
    high, low = frequent(marked, most)
    got = high.orderBy("pair").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("pair", "n", "best")))
    del got
    more_left = low is not None

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        keys, n, best = shared.value
        pairs, ptr = lists(T.column(batch, "pairs"))
        times, _ = lists(T.column(batch, "times"))
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        hit = times * known
        sums = [T.row_sums(hit * v[at] if len(keys) else hit, ptr) for v in (best.astype(np.int64), n)]
        out = [pa.array(s) for s in sums]
        if more_left:
            rest = pa.array(np.searchsorted(np.flatnonzero(~known), ptr), pa.int32())
            out += [pa.ListArray.from_arrays(rest, pa.array(v[~known])) for v in (pairs, times)]
        return out

    new = {"n_best": "long", "count_sum": "long"}
    if low is None:
        return add_columns(rows, new, run)
    row = "__row"
    while row in rows.columns:
        row += "_"
    part = stored(add_columns(rows.withColumn(row, F.monotonically_increasing_id()), new | {"__rest": "array<bigint>", "__times": "array<bigint>"}, run), "link-scores")
    more = (part.select(row, F.explode(F.arrays_zip("__rest", "__times")).alias("z")).select(row, F.col("z.__rest").alias("pair"), F.col("z.__times").alias("times"))
            .join(low, "pair").groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    joined = part.drop("__rest", "__times").join(more, row, "left")
    names = [c for c in joined.columns if c not in (row, "n_best", "count_sum", "more_best", "more_sum")]
    return joined.select(*names, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                         (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def scored_links(df: DataFrame, a_path: str, b_path: str, text: str = "text", pattern: str | None = None, most: int = FREQUENT) -> DataFrame:
    """``df`` without its text, aligned and with ``link_scores`` over all of its rows."""
    rows = stored(align(df, a_path, b_path, text, pattern).drop(text), "aligned", **DICTIONARY)
    marked = stored(best_pairs(link_counts(rows), piece_level(b_path).n), "link-counts")
    return link_scores(rows, marked, most)
