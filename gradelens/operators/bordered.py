"""All eigenvalues and vectors of a covariance whose slots, but for a few, never meet in a row.

Levels of one field never meet, so beside one large field the levels of small ones and the numbers are a border: the sums of products are a
diagonal with a border of e slots, and centring adds one more column.  The variances on the diagonal are poles; slots of one pole are turned
so that at most e + 1 of them meet the border, the others are eigenvectors as they are.  Between two poles the eigenvalues are where
a symmetric matrix of at most 2 e + 2 rows (the pole's own rows, the border less what the other poles take from it) turns singular; its
count of negative eigenvalues is the number of eigenvalues below, so each is found by halving, for itself, in Spark tasks.  The driver
holds slots x e and poles x e^2 / 2 numbers, and of every vector its part on the border and on its pole; whole vectors are made when read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters: slots of a border at most, sums that the driver reads at a time, numbers of a task's block.
MOST, PAIRS, HELD = 64, 1 << 21, 1 << 20
#: As parts of the largest one: poles as near as rounding are one, eigenvalues so near at a pole are equal, vectors of near ones are made orthogonal.
SAME, EQUAL, NEAR = 1e-14, 1e-13, 1e-11


def border(entries: DataFrame, most: int = MOST) -> list[int] | None:
    """Slots of which every two slots that meet have one, from ``entries`` (i, j, p); None where ``most`` are not found to be enough.

    A slot that meets over ``most`` others must be one of them; then at most ``most``^2 pairs can be left, else there is no such border.
    """
    pairs = entries.where((F.col("i") != F.col("j")) & (F.col("p") != 0)).select("i", "j")
    counts = pairs.select(F.explode(F.array("i", "j")).alias("s")).groupBy("s").count()
    found = [r["s"] for r in counts.where(F.col("count") > most).limit(most + 1).collect()]
    if len(found) > most:
        return None
    left = pairs.where(~F.col("i").isin(found) & ~F.col("j").isin(found)) if found else pairs
    rest = [(r["i"], r["j"]) for r in left.limit(most * most + 1).collect()]
    if len(rest) > most * most:
        return None
    while rest and len(found) < most:
        met = Counter(s for pair in rest for s in pair)
        found.append(min(met, key=lambda s: (-met[s], s)))
        rest = [pair for pair in rest if found[-1] not in pair]
    return None if rest else sorted(found)


@dataclass(frozen=True)
class Poles:
    """What a task needs: ``poles`` (rising), the rows that meet the border by pole, their products (upper half), the border's own matrix."""

    poles: np.ndarray
    rows: np.ndarray        # of all poles, one below the other
    first: np.ndarray       # first row of every pole, and the end
    products: np.ndarray    # poles x b (b + 1) / 2
    corner: np.ndarray      # b x b, the last for centring
    top: float              # no eigenvalue is above

    def matrices(self, pole: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix that is singular where ``poles[pole] + off`` is an eigenvalue, for each; and 1 / (other poles - that)."""
        b = len(self.corner)
        gap = (self.poles[None, :] - self.poles[pole][:, None]) - off[:, None]
        at = np.arange(len(pole))
        gap[at, pole] = np.inf
        inverse = 1 / np.where(gap == 0, np.finfo(float).tiny ** 0.25, gap)
        out = np.zeros((len(pole), 2 * b, 2 * b))
        low, high = np.triu_indices(b)
        out[:, b + low, b + high] = self.corner[low, high] - inverse @ self.products
        out[:, b + high, b + low] = out[:, b + low, b + high]
        own = np.arange(b - 1)
        out[:, b + own, b + own] -= (self.poles[pole] + off)[:, None]
        place = self.first[pole][:, None] + np.arange(b)
        there = place < self.first[pole + 1][:, None]
        rows = np.where(there[..., None], self.rows[np.minimum(place, len(self.rows) - 1)], 0.0)
        out[:, :b, b:] = rows
        out[:, b:, :b] = rows.transpose(0, 2, 1)
        k = np.arange(b)
        out[:, k, k] = np.where(there, -off[:, None], 1.0)      # rows that a pole lacks count for nothing
        return out, inverse

    def below(self, pole: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of eigenvalues below ``poles[pole] + off`` of the rows that meet the border and the border itself."""
        return self.first[pole] + (np.linalg.eigvalsh(self.matrices(pole, off)[0]) < 0).sum(axis=1)

    def ends(self, pole: np.ndarray) -> np.ndarray:
        """The same below the middle between every pole and the next."""
        return self.below(pole, (self.poles[np.minimum(pole + 1, len(self.poles) - 1)] - self.poles[pole]) / 2)

    def found(self, which: np.ndarray, pole: np.ndarray) -> np.ndarray:
        """Distance of eigenvalues, by number, from their pole, the nearest one."""
        near = np.concatenate([[-1.0], self.poles, [2 * self.top + 1 - self.poles[-1]]])
        low, high = (near[pole] - near[pole + 1]) / 2, (near[pole + 2] - near[pole + 1]) / 2
        low[pole == 0] = -1.0 - self.poles[0]
        for _ in range(200):
            mid = (low + high) / 2
            live = np.flatnonzero(high - low > 2.0 ** -51 * np.abs(mid) + 1e-21)
            if not len(live):
                break
            over = self.below(pole[live], mid[live]) > which[live]
            high[live[over]], low[live[~over]] = mid[live[over]], mid[live[~over]]
        return (low + high) / 2

    def vectors(self, which: np.ndarray, pole: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Eigenvectors of unit length on their pole's rows and the border."""
        b = len(self.corner)
        matrix, inverse = self.matrices(pole, off)
        turn = np.linalg.eigh(matrix)[1]
        vector = turn[np.arange(len(pole)), :, np.clip(which - self.first[pole], 0, 2 * b - 1)]
        z = vector[:, b:]
        i, j = np.triu_indices(b)
        rest = ((inverse ** 2 @ self.products) * z[:, i] * z[:, j] * np.where(i == j, 1, 2)).sum(axis=1)
        length = (vector[:, :b] ** 2).sum(axis=1) + (z[:, :-1] ** 2).sum(axis=1) + rest
        return vector / np.sqrt(length)[:, None]


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues, falling, and what their vectors are made of."""

    values: np.ndarray
    pole: np.ndarray
    off: np.ndarray
    vectors: np.ndarray     # on the pole's rows and the border
    own: np.ndarray         # number of the vector among those that meet no border, else -1
    border: np.ndarray      # slots
    inner: np.ndarray       # the other slots, by pole
    start: np.ndarray       # first inner slot of every pole, and the end
    sums: np.ndarray        # inner slots x b
    poles: np.ndarray
    whole: float            # sum of the variances

    def columns(self, k: int, block: int = 256) -> np.ndarray:
        """The first ``k`` eigenvectors: slots x k."""
        b, out = self.sums.shape[1], np.zeros((len(self.inner) + len(self.border), k))
        meet = np.flatnonzero(self.own[:k] < 0)
        for c in range(0, len(meet), block):
            at = meet[c:c + block]
            z = self.vectors[at, b:]
            gap = (self.poles[:, None] - self.poles[self.pole[at]]) - self.off[at]
            gap[self.pole[at], np.arange(len(at))] = np.inf
            out[np.ix_(self.inner, at)] = -(self.sums @ z.T) / np.repeat(gap, np.diff(self.start), axis=0)
            out[np.ix_(self.border, at)] = z[:, :-1].T
        for g in np.unique(self.pole[:k]):
            at, rows = np.flatnonzero(self.pole[:k] == g), slice(self.start[g], self.start[g + 1])
            out[np.ix_(self.inner[rows], at)] = self._on_pole(self.sums[rows], at)
        for at in np.split(meet, np.flatnonzero(-np.diff(self.values[meet]) > NEAR * self.values[0]) + 1):
            if len(at) > 1:
                out[:, at] = np.linalg.qr(out[:, at])[0]
        return out

    def _on_pole(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the vectors ``at`` are on the slots of their pole: turned back by the reflections that made ``rows`` few."""
        m, b = rows.shape
        out, met, alone = np.zeros((m, len(at))), min(m, b), np.flatnonzero(self.own[at] >= 0)
        out[:met] = self.vectors[at, :met].T
        out[met + self.own[at[alone]], alone] = 1
        if m > b:
            h, tau = np.linalg.qr(rows, mode="raw")
            for k in range(b - 1, -1, -1):
                v = np.concatenate([np.zeros(k), [1.0], h[k, k + 1:]])
                out -= np.outer(tau[k] * v, v @ out)
        return out


def spectrum(entries: DataFrame, size: int, edge: list[int], n: int, means: np.ndarray) -> Spectrum:
    """All eigenvalues of the covariance of ``n`` rows from their sums of products ``entries`` (i, j, p), each pair of slots once."""
    place = np.full(size, -1)
    place[edge] = np.arange(len(edge))
    diagonal, cross = np.zeros(size), np.zeros((size, len(edge)))
    read = entries.where((F.col("i") == F.col("j")) | F.col("i").isin(edge) | F.col("j").isin(edge)).select("i", "j", "p")
    slices = read.count() // PAIRS + 1
    for k in range(slices):
        t = read.where(F.pmod(F.col("i") + F.col("j"), F.lit(slices)) == k).toArrow()
        i, j, p = (t.column(c).to_numpy() for c in ("i", "j", "p"))
        one = i == j
        diagonal[i[one]] = p[one]
        for x, y in ((i, j), (j, i)):
            to = ~one & (place[y] >= 0)
            cross[x[to], place[y[to]]] = p[to]
    if not (np.isfinite(diagonal).all() and np.isfinite(cross).all() and np.isfinite(means).all()):
        raise np.linalg.LinAlgError("covariance of values that are not finite")
    whole = float((diagonal - n * means ** 2).sum() / (n - 1))
    scale = diagonal.max() / (n - 1) or 1.0
    diagonal /= scale * (n - 1)
    sums = np.concatenate([cross / (scale * (n - 1)), (means * np.sqrt(n / (n - 1) / scale))[:, None]], axis=1)
    corner = np.zeros((len(edge) + 1, len(edge) + 1))
    corner[:-1] = sums[edge]
    corner[:-1, :-1][np.diag_indices(len(edge))] = diagonal[edge]
    corner[-1] = [*corner[:-1, -1], 1.0]
    top = max(1.0, 2 * float((diagonal - sums[:, -1] ** 2).clip(0).sum()))
    inner = np.flatnonzero(place < 0)
    inner = inner[np.argsort(diagonal[inner], kind="stable")]
    start = np.concatenate([[0], np.flatnonzero(np.diff(diagonal[inner]) > SAME) + 1, [len(inner)]])
    poles, sums = diagonal[inner][start[:-1]], sums[inner]
    b = sums.shape[1]
    rows = [x if len(x) <= b else np.linalg.qr(x, mode="r") for x in np.split(sums, start[1:-1])]
    low, high = np.triu_indices(b)
    products = np.empty((len(poles), len(low)))
    for c, (x, y) in enumerate(zip(low, high)):
        products[:, c] = np.add.reduceat(sums[:, x] * sums[:, y], start[:-1])
    parts = Poles(poles, np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]), products, corner, top)
    pole, off, vectors = _solved(entries.sparkSession, parts)
    spare = np.diff(start) - np.diff(parts.first)
    pole = np.concatenate([pole, np.repeat(np.arange(len(poles)), spare)])
    own = np.concatenate([np.full(len(off), -1), np.arange(spare.sum()) - np.repeat(np.cumsum(spare) - spare, spare)])
    off = np.concatenate([off, np.zeros(spare.sum())])
    vectors = np.concatenate([vectors, np.zeros((spare.sum(), 2 * b))])
    fall = np.argsort(-(poles[pole] + off), kind="stable")
    return Spectrum(scale * (poles[pole] + off)[fall], pole[fall], off[fall], vectors[fall], own[fall], np.asarray(edge, np.int64), inner, start, sums, poles, whole)


def _solved(spark: SparkSession, parts: Poles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pole, distance, vector) of every eigenvalue but those of slots that meet no border."""
    b, shared = len(parts.corner), spark.sparkContext.broadcast(parts)
    total = int(parts.first[-1]) + b - 1
    block = max(1, HELD // (max(len(parts.poles), 8 * b) + 4 * b * b))

    def dealt(count: int) -> DataFrame:
        return spark.range(0, count, 1, max(1, min(count // 8, 4 * spark.sparkContext.defaultParallelism)))

    def pieces(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield from (ids[c:c + block] for c in range(0, len(ids), block))

    def counts(batches):
        for ids in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shared.value.ends(ids))], names=["id", "n"])

    ends = np.zeros(len(parts.poles), np.int64)
    for batch in dealt(len(ends)).mapInArrow(counts, "id long, n long").toArrow().to_batches():
        ends[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    ends[-1] = total
    ends = np.minimum(np.maximum.accumulate(ends), total)
    pole = np.searchsorted(ends, np.arange(total), side="right")
    poles = spark.sparkContext.broadcast(pole)

    def distances(batches):
        for ids in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shared.value.found(ids, poles.value[ids]))], names=["id", "off"])

    off = np.zeros(total)
    for batch in dealt(total).mapInArrow(distances, "id long, off double").toArrow().to_batches():
        off[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    # equal eigenvalues take their vectors from one matrix, so that none comes twice
    apart = np.concatenate([[True], (np.diff(pole) > 0) | (np.diff(off) > EQUAL)])
    common = spark.sparkContext.broadcast(off[apart][np.cumsum(apart) - 1])

    def solved(batches):
        for ids in pieces(batches):
            found = shared.value.vectors(ids, poles.value[ids], common.value[ids])
            col = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * 2 * b, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), col], names=["id", "v"])

    vectors = np.zeros((total, 2 * b))
    for batch in dealt(total).mapInArrow(solved, "id long, v array<double>").toArrow().to_batches():
        vectors[batch.column(0).to_numpy()] = batch.column(1).flatten().to_numpy().reshape(-1, 2 * b)
    for x in (shared, poles, common):
        x.unpersist()
    return pole, off, vectors
