"""Operator 10, near-duplicate documents by SetSketch registers.

A document is the set of its word shingles.  Its sketch has ``REGISTERS`` registers: each shingle is a Poisson
process of points, each point falls into one register, and a register holds the least point of all shingles on a
logarithmic scale of base ``SCALE``, truncated to one byte.  Registers of a union are the larger ones of both, so sketches
merge; equal registers are as likely as the sets are similar, so they can be banded.

1. Documents with equal sets (128-bit digest) are one class, named by the row key (128 bits of id and text) of one of its rows.
2. Bands of ``BAND`` registers give buckets.  Every class is paired with the smallest class of each of its buckets; the
   likelihood of the register pairs, given both set sizes, estimates their similarity.  Pairs estimated at ``MARGIN`` below the threshold
   or higher are verified on the full sets.  They give first components.
3. Buckets of three or more that still hold several components are compared further.  A component of more than ``CELL`` members is
   dealt into cells and stands in a bucket by its cells; members of smaller ones stand for themselves and are compared by their
   registers, in blocks of ``BLOCK`` rows.  What is plausible asks for the other component's cell, and asker and cell are compared by
   registers and then on the full sets.  These are all the pairs left in buckets, so no link between components is lost; pairs inside one
   component are never listed, so a large group of copies costs its size, not its square.

A pair at similarity 0.8 shares a bucket but for a chance of (1 - 0.8^BAND)^BANDS = 1.3e-7.  The margin is about five standard
deviations of the estimate.  Full sets are compared by 64-bit shingle hashes.

Defined results: NULL and empty texts and texts without a word have no shingle, are linked with nothing and kept.  A text
with fewer words than a shingle is one shingle.  Rows that repeat an id are judged row by row.  Rows without an id are never the
representative; they are kept if no other row of their class has an id.  Empty tables give empty results;
clashing input columns are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import map_batches
from gradelens.llm.bloom import contains, hash_filter, segments_for
from gradelens.llm.shared import stored

#: Parameters of the sketch: bands, registers of a band, base of the register scale, its zero point, chance of an empty register (e^-x).
BANDS, BAND = 40, 5
REGISTERS = BANDS * BAND
SCALE = 1.105
ZERO = 3.2
EMPTY = 8.0
#: Parameters of the search: words of a shingle, similarity in percent, margin of the estimate, rows of a block and of a cell, filter bits.
SHINGLE = 5
PERCENT = 80
MARGIN = 0.14
BLOCK = 1024
CELL = 256
BITS_PER_ID, MAX_BITS = 12, 1 << 27


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    _, _, ptr, words = T.words_of(data, at, T.NOT_SPACE)
    h, first = T.shingle_hashes(words, ptr, k)
    cut = np.searchsorted(first, ptr)
    out = []
    for r in range(len(at) - 1):
        if cut[r + 1] > cut[r]:
            out.append(np.unique(h[cut[r]:cut[r + 1]]))
        elif ptr[r + 1] > ptr[r]:
            n = int(ptr[r + 1] - ptr[r])
            out.append(T.shingle_hashes(words[ptr[r]:ptr[r + 1]], np.array([0, n]), n)[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Rows x registers (uint8); 0 marks a register without a point before the row's horizon."""
    n = np.array([len(s) for s in sets])
    horizon = (np.log(REGISTERS) + EMPTY) / np.maximum(n, 1)
    state = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), n)
    x, best = np.zeros(len(state)), np.full(len(sets) * REGISTERS, np.inf)
    while len(state):
        state = T.mix(state + T.U64(T.BASE))
        x = x - np.log(((state >> T.U64(24)).astype(np.float64) + 1) * 2.0 ** -40) / REGISTERS
        alive = x <= horizon[row]
        state, x, row = state[alive], x[alive], row[alive]
        register = ((state & T.U64(0xFFFFFF)) * T.U64(REGISTERS) >> T.U64(24)).astype(np.int64)
        np.minimum.at(best, row * REGISTERS + register, x)
    filled = np.isfinite(best)
    level = np.zeros(len(best), np.uint8)
    level[filled] = np.clip((ZERO - np.log(best[filled])) / np.log(SCALE), 1, 255).astype(np.uint8)
    return level.reshape(len(sets), REGISTERS)


def row_key(own: Column, text: Column) -> Column:
    """128 bits that name a row by its id and its text."""
    mark = F.concat(F.when(own.isNull(), "").otherwise(F.concat(F.lit("id "), own.cast("string"))), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(mark.cast("binary")))


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(i, id, t) of every row, ``i`` its ``row_key``: texts that share an id stay apart."""
    own, t = F.col(f"`{id_col}`"), F.col(f"`{text}`")
    return docs.select(row_key(own, t).alias("i"), own.alias("id"), t.alias("t"))


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """(i, id, n, digest, sketch) of each keyed row; no digest and sketch without a word."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, digests, regs = [], [], []
            for _, _, data, at in T.slices(*T.utf8(b.column(2))):
                sets = shingle_sets(data, at, k)
                n += [len(s) for s in sets]
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                regs += [r.tobytes() if len(s) else None for s, r in zip(sets, sketches(sets))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
                                             names=["i", "id", "n", "digest", "sketch"])

    return map_batches(rows, run, f"i binary, id {kind}, n long, digest binary, sketch binary")


GRID = np.linspace(0.3, 1.0, 71)


def similarity(more: np.ndarray, less: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity given how many registers are larger and smaller in u than in v and both set sizes."""
    out = np.empty(len(more))

    def chance(x):      # of a larger register, from the share x of the union that only one set has
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE), 1e-6, 1)

    for lo in range(0, len(more), 4096):
        m, s = more[lo:lo + 4096, None], less[lo:lo + 4096, None]
        u = (nu[lo:lo + 4096] / (nu[lo:lo + 4096] + nv[lo:lo + 4096]))[:, None]
        w = np.minimum(GRID, np.minimum(u / (1 - u), (1 - u) / u))
        pu, pv = chance(u - (1 - u) * w), chance(1 - u - u * w)
        like = m * np.log(pu) + s * np.log(pv) + (REGISTERS - m - s) * np.log(np.clip(1 - pu - pv, 1e-6, 1))
        out[lo:lo + 4096] = w[np.arange(len(w)), like.argmax(1)]
    return out


def sizes_allow(nu: np.ndarray, nv: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(nu, nv) >= percent * np.maximum(nu, nv)


def registers(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), REGISTERS)


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, est) of the pairs whose sizes and registers allow the similarity."""
    kind = nodes.schema["i"].dataType.simpleString()
    least = percent / 100 - MARGIN
    both = (pairs.join(nodes.select(F.col("i").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(nodes.select(F.col("i").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
            .select("a", "b", "na", "nb", "sa", "sb"))

    def run(batches):
        for b in batches:
            na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            ra, rb = registers(b.column(4)), registers(b.column(5))
            est = similarity((ra > rb).sum(1), (ra < rb).sum(1), na, nb)
            at = pa.array(np.flatnonzero(sizes_allow(na, nb, percent) & (est >= least)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(est).take(at)], names=["a", "b", "est"])

    return map_batches(both, run, f"a {kind}, b {kind}, est double")


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(i, t) of the documents whose id a Bloom filter of ``ids`` knows: few others come along, so little text shuffles later."""
    hashes = ids.select(F.xxhash64("i").alias("h"))
    table = docs.sparkSession.sparkContext.broadcast(hash_filter(hashes, segments_for(ids.count(), BITS_PER_ID, MAX_BITS)))
    kind = docs.schema[id_col].dataType.simpleString()

    def known(batches):
        for b in batches:
            at = pa.array(np.flatnonzero(contains(table.value, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["i", "t"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.xxhash64(id_col).alias("h"))
    return map_batches(rows, known, f"i {kind}, t string")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("i")), docs, id_col, text)
    both = (pairs.select("a", "b").join(texts.select(F.col("i").alias("a"), F.col("t").alias("ta")), "a")
            .join(texts.select(F.col("i").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches):
        for b in batches:
            keep = []
            for r in range(len(b)):
                two = [_set_of(b.column(c)[r].as_py(), k) for c in (2, 3)]
                common = len(np.intersect1d(*two, assume_unique=True))
                if common and 100 * common >= percent * (len(two[0]) + len(two[1]) - common):
                    keep.append(r)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return map_batches(both, run, f"a {kind}, b {kind}")


def grouped(batches, names: list[str]):
    """Consecutive rows with equal ``names`` as one table each, from batches in that order."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        keys = [t.column(c).to_numpy() for c in names]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1 if len(t) > 1 else []
        edges = [0, *[int(x) for x in change]]
        for lo, hi in zip(edges, edges[1:]):
            yield t.slice(lo, hi - lo)
        rest = t.slice(edges[-1])
    if rest is not None and len(rest):
        yield rest


def verified_cells(demand: DataFrame, rooted: DataFrame, docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """Links (a, b = root) of demanded (i, root, cell): a full set of the cell's members is similar enough to that of ``i``.

    A cell has at most about ``CELL`` members; the rows that ask for one are dealt into parts of about as many, so no task
    meets more than two such blocks, and every text goes to a block once, not once a pair.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    cells = stored(demand.groupBy("root", "cell").agg(F.ceil(F.count("*") / CELL).alias("parts")), "cells")
    place = F.xxhash64("root", "cell", "part").alias("block")
    mine = (rooted.join(cells, ["root", "cell"]).select("i", "root", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
            .select("i", "root", place, F.lit(0).alias("side")))
    theirs = (demand.join(cells, ["root", "cell"]).select("i", "root", "cell", F.pmod(F.xxhash64("i"), F.col("parts")).alias("part"))
              .select("i", "root", place, F.lit(1).alias("side")))
    rows = stored(mine.union(theirs), "cell-rows")
    texts = texts_of(rows.select("i"), docs, id_col, text)
    dealt = rows.join(texts, "i").select("block", "side", "i", "root", "t").repartition("block").sortWithinPartitions("block", "side")

    def run(batches):
        for t in grouped(batches, ["block"]):
            side = t.column("side").to_numpy()
            cut = int((side == 0).sum())
            if cut == 0 or cut == len(side):
                continue
            sets = [_set_of(x, k) for x in t.column("t").to_pylist()]
            regs, n = sketches(sets), np.array([len(x) for x in sets])
            found = []
            for r in range(cut, len(side)):
                q = np.flatnonzero(sizes_allow(n[:cut], n[r], percent) & (2 * (regs[:cut] == regs[r]).sum(1) >= REGISTERS))
                est = similarity((regs[q] > regs[r]).sum(1), (regs[q] < regs[r]).sum(1), n[q], np.full(len(q), n[r]))
                q = q[est >= percent / 100 - MARGIN]
                for x in q[np.argsort(-est[est >= percent / 100 - MARGIN])]:
                    common = len(np.intersect1d(sets[x], sets[r], assume_unique=True))
                    if 100 * common >= percent * (n[x] + n[r] - common):
                        found.append(r)
                        break
            at = pa.array(found, pa.int64())
            yield from pa.table([t.column("i").take(at), t.column("root").take(at)], names=["a", "b"]).to_batches()

    return map_batches(dealt, run, f"a {kind}, b {kind}").distinct()


def _set_of(text: str | None, k: int) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), k)[0]


def keys_of(regs: np.ndarray) -> np.ndarray:
    """Rows x bands: the bucket keys of sketches (a hash of the band's number and registers)."""
    bands = regs.reshape(len(regs), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)).copy()
    for j in range(BAND):
        key = T.mix(key * T.U64(T.BASE) + bands[:, :, j])
    return key


def band_rows(nodes: DataFrame) -> DataFrame:
    """(i, key): one bucket key per class and band."""
    kind = nodes.schema["i"].dataType.simpleString()

    def run(batches):
        for b in batches:
            key = keys_of(registers(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(b)), BANDS))), pa.array(key.ravel().view(np.int64))],
                                             names=["i", "key"])

    return map_batches(nodes.select("i", "sketch"), run, f"i {kind}, key long")


def components(edges: DataFrame) -> DataFrame:
    """(i, root) of every node of the edges (a, b), one root per connected component.

    Each round every node hooks to the neighbour with the least hash if it is less than its own, jumps once more along the hooks,
    and the edges are drawn between the new names; rounds end when no edge is left.  Hash order makes the rounds few on any graph.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    label = None
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("i"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("i"))
        hook = stored(near.select(F.col("a").alias("i"), F.least("m", own)["i"].alias("p")), "hooks")
        up = hook.select(F.col("i").alias("p"), F.col("p").alias("pp"))
        step = stored(hook.join(up, "p").select("i", F.col("pp").alias("root")), "steps")
        if label is None:
            label = step
        else:
            more = step.select(F.col("i").alias("root"), F.col("root").alias("next"))
            label = stored(label.join(more, "root", "left").select("i", F.coalesce("next", "root").alias("root")), "labels")
        a = step.select(F.col("i").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("i").alias("b"), F.col("root").alias("rb"))
        drawn = edges.join(a, "a").join(b, "b").where(F.col("ra") != F.col("rb"))
        edges = stored(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return label if label is not None else edges.select(F.col("a").alias("i"), F.col("b").alias("root"))


def key_filter(keys: DataFrame):
    """A broadcast Bloom filter of bucket keys."""
    return keys.sparkSession.sparkContext.broadcast(hash_filter(keys, segments_for(keys.count(), BITS_PER_ID, MAX_BITS)))


def bucket_rows(tagged: DataFrame, large) -> DataFrame:
    """(key, band, i, root, cell, n, sketch) of the buckets that the filter ``large`` knows: members of small components, each cell of a big one once a batch.

    A cell's row has no i and no sketch, so a big component costs a bucket its cells, not its members.
    """
    kind = tagged.schema["i"].dataType.simpleString()
    columns = ["i", "root", "cell", "n", "sketch", "big"]

    def run(batches):
        for b in batches:
            key = keys_of(registers(b.column(4)))
            row, band = np.nonzero(contains(large.value, key.ravel()).reshape(key.shape))
            big = b.column(5).to_numpy(zero_copy_only=False)[row]
            t = pa.Table.from_batches([b]).select(columns[:5]).take(pa.array(row))
            t = t.append_column("key", pa.array(key[row, band].view(np.int64))).append_column("band", pa.array(band.astype(np.int32)))
            names = ["key", "band", "i", "root", "cell", "n", "sketch"]
            yield from t.filter(pa.array(~big)).select(names).to_batches()
            cells = t.filter(pa.array(big)).group_by(["key", "band", "root", "cell"]).aggregate([])
            none = [pa.nulls(len(cells), t.schema.field(c).type) for c in ("i", "n", "sketch")]
            for c, v in zip(("i", "n", "sketch"), none):
                cells = cells.append_column(c, v)
            yield from cells.select(names).to_batches()

    return map_batches(tagged.select(*columns), run, f"key long, band int, i {kind}, root {kind}, cell long, n long, sketch binary")


def demanded_cells(rows: DataFrame, percent: int) -> DataFrame:
    """(i, root, cell): members of small components and the cells of other components that they may be linked with.

    Small members are compared by their registers, block by block, in the first band that a pair shares only; every cell of a big
    component in the bucket is asked.
    """
    kind = rows.schema["i"].dataType.simpleString()
    least = percent / 100 - MARGIN
    spot = F.pmod(F.xxhash64("i", "root", "cell"), F.lit(1 << 30))
    sized = (rows.groupBy("key").agg(F.count("i").alias("n_small"), F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("n_small > 0 and lo <> hi"))
    blocks = sized.select("key", F.ceil(F.col("size") / BLOCK).alias("n_all"), F.ceil(F.col("n_small") / BLOCK).alias("n_ask"))
    full = rows.join(blocks, "key")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    rest = ["band", "i", "root", "cell", "n", "sketch"]
    left = full.where(F.col("i").isNotNull()).select("key", (spot % F.col("n_ask")).alias("x"), F.explode(upto(F.col("n_all"))).alias("y"), F.lit(0).alias("side"), *rest)
    right = full.select("key", F.explode(upto(F.col("n_ask"))).alias("x"), (spot % F.col("n_all")).alias("y"), F.lit(1).alias("side"), *rest)
    dealt = left.union(right).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")

    def demands(t: pa.Table):
        """(asking row, asked row) numbers of one block, one for each asking row and asked cell."""
        side = t.column("side").to_numpy()
        cut = int((side == 0).sum())
        if cut == 0:
            return
        _, root = np.unique(np.array(t.column("root").to_pylist()), return_inverse=True)
        cell, big = t.column("cell").to_numpy(), np.array([x is None for x in t.column("i").to_pylist()])
        small = np.flatnonzero(~big)
        ids, n, band = (np.array(t.column(c).take(pa.array(small)).to_pylist()) for c in ("i", "n", "band"))
        regs = registers(t.column("sketch").take(pa.array(small)).combine_chunks())
        place = np.zeros(len(side), np.int64)
        place[small] = np.arange(len(small))
        cells = np.flatnonzero(big)
        for p in range(cut):
            me = place[p]
            q = small[small >= cut]
            o = place[q]
            ok = (root[q] != root[p]) & sizes_allow(n[o], n[me], percent) & (ids[o] > ids[me])
            q, o = q[ok], o[ok]
            same = regs[o] == regs[me]
            first = same.reshape(len(o), BANDS, BAND).all(2).argmax(1) == band[me]
            near = first & (2 * same.sum(1) >= REGISTERS)
            q, o = q[near], o[near]
            if len(q):
                est = similarity((regs[me] > regs[o]).sum(1), (regs[me] < regs[o]).sum(1), np.full(len(o), n[me]), n[o])
                q = q[est >= least]
            yield from ((p, x) for x in np.concatenate([q, cells]))

    def run(batches):
        for t in grouped(batches, ["key", "x", "y"]):
            found = list(demands(t))
            if found:
                asking, asked = (pa.array(c, pa.int64()) for c in zip(*found))
                yield from pa.table([t.column("i").take(asking), t.column("root").take(asked), t.column("cell").take(asked)],
                                    names=["i", "root", "cell"]).to_batches()

    return map_batches(dealt, run, f"i {kind}, root {kind}, cell long").distinct()


def big_demands(rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """(i, root, cell) for cells of two big components in one bucket: all members of the one ask the other."""
    cells = rows.where(F.col("i").isNull()).select("key", "root", "cell").distinct()
    one = cells.select("key", F.col("root").alias("r1"), F.col("cell").alias("c1"))
    pairs = one.join(cells, "key").where(F.col("r1") < F.col("root")).select("r1", "c1", "root", "cell").distinct()
    members = rooted.select("i", F.col("root").alias("r1"), F.col("cell").alias("c1"))
    return pairs.join(members, ["r1", "c1"]).select("i", "root", "cell")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id`` (smallest linked id, its own included), ``kept`` and ``row_key``
    (``keyed``: names the row by id and text)."""
    rows = keyed(docs, id_col, text)
    signed = stored(signatures(rows, k), "signatures")
    classes = stored(signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull()).groupBy("digest")
                     .agg(F.min("i").alias("class"), F.min("id").alias("smallest")), "classes")
    first = classes.select(F.col("class").alias("i"))
    nodes = stored(signed.join(first, "i").where(F.col("digest").isNotNull()).select("i", "n", "sketch").distinct(), "nodes")
    bands = band_rows(nodes)
    buckets = stored(bands.groupBy("key").agg(F.min("i").alias("lead"), F.count("*").alias("size")).where(F.col("size") > 1), "buckets")
    stars = (bands.join(buckets.select("key", "lead"), "key").where(F.col("i") != F.col("lead"))
             .select(F.col("i").alias("a"), F.col("lead").alias("b")).distinct())
    plausible = stored(estimated(stars, nodes, percent), "plausible")
    label = components(verified(plausible, rows, "i", "t", k, percent))
    sized = label.groupBy("root").agg(F.count("*").alias("members"))
    own = label.join(sized, "root").select("i", "root", F.pmod(F.xxhash64(F.col("i"), F.lit(2)), F.ceil(F.col("members") / CELL)).alias("cell"),
                                           (F.col("members") > CELL).alias("big"))
    tagged = stored(nodes.join(own, "i", "left").select("i", F.coalesce("root", "i").alias("root"), F.coalesce("cell", F.lit(0).cast("long")).alias("cell"), "n", "sketch",
                                                        F.coalesce("big", F.lit(False)).alias("big")), "tagged")
    rooted = tagged.select("i", "root", "cell")
    found = stored(bucket_rows(tagged, key_filter(buckets.where("size > 2").select("key"))), "bucket-rows")
    bucketed = found.where(F.col("i").isNotNull()).union(found.where(F.col("i").isNull()).distinct())
    demand = stored(demanded_cells(bucketed, percent).union(big_demands(bucketed, rooted)), "demand")
    links = verified_cells(demand, rooted, rows, "i", "t", k, percent)
    asker = rooted.select(F.col("i").alias("a"), F.col("root").alias("ra"))
    over = components(links.join(asker, "a").select(F.col("ra").alias("a"), "b"))

    final = stored(classes.join(label.select(F.col("i").alias("class"), "root"), "class", "left").select("digest", "smallest", F.coalesce("root", "class").alias("root"))
                   .join(over.select(F.col("i").alias("root"), F.col("root").alias("next")), "root", "left")
                   .select("digest", "smallest", F.coalesce("next", "root").alias("root")), "final")
    smallest = stored(final.groupBy("root").agg(F.min("smallest").alias("component_id")), "smallest")
    member = stored(final.join(smallest, "root").select("digest", "component_id"), "membership")
    return (signed.select("i", "id", "n", "digest").join(member, "digest", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("i").alias("row_key"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull())))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    kept = near_duplicates(docs, id_col, text, k, percent).where("kept").select("row_key").distinct()
    name = "__row_key"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, row_key(F.col(f"`{id_col}`"), F.col(f"`{text}`")))
    return marked.join(kept.withColumnRenamed("row_key", name), name, "left_semi").drop(name).select(*docs.columns)
