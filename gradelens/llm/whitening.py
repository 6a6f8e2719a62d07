"""Operator 11, embedding whitening with polarisation covariance.

Entries become integers, so that every sum is exact.  Tasks add up the squares of the centred values of each dimension and of each sum
of two dimensions, of single rows ``x - m`` (``m`` the integers nearest to the means; the remainder of the mean is taken off exactly
afterwards).  Differences of these variances are the covariances: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2.  The matrix is put
together on the driver from exact integers (dims^2 numbers, whatever the rows) and goes through ``eigh``.

The fit list is each distinct integer vector once, stored; the sums of a task are one row per dimension or pair of dimensions, so rows
never gather by key.  ``whiten`` projects every row with an integer vector on the components of positive variance.

Defined results: rows whose vector is NULL, empty, or holds NULL, non-finite or too large entries (``scale`` times an entry of 2^61 or
more is no long) are dropped, as are vectors of another length than the commonest of the fit list (ties: the longer).  Repeated rows
count once in the fit and are each returned; NULL ids stay.  Ties between eigenvalues leave their components' order to ``eigh``, the same
for all rows.  Components without variance (below the rounding of ``eigh``) are left out: a fit list of one vector, or an empty table,
has none, and the arrays are empty.  Clashing input columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens.llm import text as T
from gradelens.llm.arrow import add_columns, map_batches
from gradelens.llm.shared import stored

#: Parameters: factor and offset of the integers, components of the result.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Rows squared at a time, and the largest centred value whose pair sums of so many rows stay within 63 bits.
ROWS = 1024
SMALL = 1 << 25
#: Sums are shipped as high * BASE + low, each a DECIMAL(38, 0).
BASE = 10 ** 18
PART = "i int, high decimal(38,0), low decimal(38,0)"


def integers(col: pa.Array, scale: int = SCALE, offset: int = OFFSET) -> pa.Array:
    """Each row's floor(scale * entry) + offset as little-endian 64-bit bytes; NULL for rows without such integers."""
    at = col.offsets.to_numpy().astype(np.int64)
    at = np.minimum(at, len(col.values))
    v = pc.cast(col.values.slice(at[0], at[-1] - at[0]), pa.float64()).to_numpy(zero_copy_only=False)
    at = at - at[0]
    with np.errstate(over="ignore", invalid="ignore"):
        wide = np.floor(v * scale)
        good = np.abs(wide) < 2.0 ** 61
    x = np.where(good, wide, 0).astype(np.int64) + offset
    ok = (T.row_sums((~good).astype(np.int64), at) == 0) & (np.diff(at) > 0) & ~col.is_null().to_numpy(zero_copy_only=False)
    data = x.view(np.uint8)
    size = np.where(ok, 8 * np.diff(at), 0)
    if not ok.all():
        data = data[np.repeat(ok, 8 * np.diff(at))]
    out = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    known = pa.array(ok)
    return pc.if_else(known, pa.Array.from_buffers(pa.binary(), len(ok), [None, out.buffers()[1], pa.py_buffer(data.tobytes())]), pa.scalar(None, pa.binary()))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Rows x dims of a column of packed integers without NULLs."""
    return np.frombuffer(b"".join(col.to_pylist()), np.int64).reshape(len(col), dims)


class Exact:
    """Sums of int64 arrays of one length, kept as high * 2^32 + low per place; Python integers in the end."""

    def __init__(self, n: int):
        self.high, self.low, self.wide = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, object)

    def add(self, part: np.ndarray) -> None:
        if part.dtype == object:
            self.wide += part
        else:
            self.high += part >> 32
            self.low += part & 0xFFFFFFFF

    def rows(self) -> pa.RecordBatch:
        total = [(int(h) << 32) + int(lo) + int(w) for h, lo, w in zip(self.high, self.low, self.wide)]
        split = [divmod(t, BASE) for t in total]
        kind = pa.decimal128(38, 0)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([Decimal(h) for h, _ in split], kind),
                                           pa.array([Decimal(lo) for _, lo in split], kind)], names=["i", "high", "low"])


def exact_sums(xs: DataFrame, places: int, dims: int, parts) -> list[int]:
    """The exact sum over all rows of each place of the arrays that ``parts`` makes from matrices of rows."""

    def run(batches):
        total = Exact(places)
        for b in batches:
            x = matrix(b.column(0), dims)
            for lo in range(0, len(x), ROWS):
                for p in parts(x[lo:lo + ROWS]):
                    total.add(p)
        yield total.rows()

    rows = map_batches(xs, run, PART).groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out = [0] * places
    for r in rows:
        out[r.i] = int(r.high) * BASE + int(r.low)
    return out


def squares(r: np.ndarray) -> np.ndarray:
    """Sums over rows of the squares of every dimension, then of every sum of two dimensions i < j."""
    dims = r.shape[1]
    one = (r * r).sum(0)
    two = []
    for i in range(dims - 1):
        pair = r[:, i + 1:] + r[:, i:i + 1]
        two.append(np.einsum("ij,ij->j", pair, pair) if r.dtype != object else (pair * pair).sum(0))
    return np.concatenate([one, *two])


def covariance_numerators(q: list[int], dims: int, n: int, rest: list[int]) -> list[list[int]]:
    """n^2 times the covariance matrix, in exact integers: polarisation, then the remainder of the means taken off."""
    one, pair = q[:dims], iter(q[dims:])
    out = [[0] * dims for _ in range(dims)]
    for i in range(dims):
        out[i][i] = n * one[i] - rest[i] * rest[i]
        for j in range(i + 1, dims):
            out[i][j] = out[j][i] = n * ((next(pair) - one[i] - one[j]) // 2) - rest[i] * rest[j]
    return out


@dataclass(frozen=True)
class Whitening:
    """What a fit list gives: its size, the centre with the exact rest of n * mean, components (dims x k) by falling eigenvalue."""

    n: int
    centre: np.ndarray
    rest: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    scale: int = SCALE
    offset: int = OFFSET
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.centre)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows x components: centred, projected, over the standard deviation."""
        centred = (x - self.centre).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)^2, exact; NULL beyond 38 digits."""
        r = x - self.centre
        most = self.n * int(np.abs(r).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most ** 2 * self.dims < 1 << 63:
            z = self.n * r - np.array(self.rest, np.int64)
            return pa.array((z * z).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
        z = self.n * r.astype(object) - np.array(self.rest, object)
        return pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in (z * z).sum(1)], pa.decimal128(38, 0))


PACKED = "__packed"


def packed(df: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """``df`` with the integers of ``vector`` as bytes in ``PACKED``."""
    return add_columns(df, {PACKED: "binary"}, lambda b: [integers(T.column(b, vector), scale, offset)])


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The whitening of the distinct integer vectors of ``df``."""
    xs = stored(packed(df.select(vector), vector, scale, offset).select(PACKED).where(F.col(PACKED).isNotNull()).distinct(), "whitening-fit")
    size = F.octet_length(PACKED)
    common = xs.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return Whitening(0, np.zeros(0, np.int64), (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), scale, offset)
    dims, n = common["size"] // 8, common["count"]
    xs = xs.where(size == common["size"])
    total = exact_sums(xs, dims, dims, lambda x: [x.sum(0) if np.abs(x).max() < 1 << 52 else x.astype(object).sum(0)])
    centre = [(2 * s + n) // (2 * n) for s in total]
    middle, rest = np.array(centre, np.int64), tuple(s - n * c for s, c in zip(total, centre))

    def parts(x):
        small = (np.abs(x - middle) < SMALL).all(1)
        if small.any():
            yield squares(x[small] - middle)
        if not small.all():
            yield squares(x[~small].astype(object) - middle.astype(object))

    above = covariance_numerators(exact_sums(xs, dims * (dims + 1) // 2, dims, parts), dims, n, rest)
    v = np.array([[a / n ** 2 for a in row] for row in above])
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    k = min(components, int((e > 4 * dims * np.finfo(float).eps * max(e[0], 0)).sum()))
    p = p * np.where(p[np.abs(p).argmax(0), np.arange(dims)] < 0, -1, 1)
    trace = sum(above[i][i] for i in range(dims)) / n ** 2
    model = Whitening(n, middle, rest, p[:, :k], e[:k], e[:k] / trace if k else np.zeros(0), scale, offset)
    return Whitening(**{**vars(model), "identity_error": identity_error(xs, model)})


def identity_error(xs: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, by a pass over the list."""
    k, dims = model.components.shape[1], model.dims
    if not k:
        return 0.0

    def run(batches):
        square, mean = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            w = model.project(matrix(b.column(0), dims))
            square += w.T @ w
            mean += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k), pa.int32()), pa.array(np.concatenate([square.ravel(), mean]))], names=["i", "s"])

    got = {r.i: r.s for r in map_batches(xs, run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    flat = np.array([got[i] for i in range(k * k + k)]) / model.n
    return float(np.abs(flat[:k * k].reshape(k, k) - np.outer(flat[k * k:], flat[k * k:]) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows of ``df`` with an integer vector of the model's length, with ``deviation`` (of n * x from the sums) and ``whitened``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        col = integers(T.column(batch, vector), m.scale, m.offset)
        ok = pc.equal(pc.binary_length(col), 8 * m.dims).fill_null(False) if m.dims else pa.array(np.zeros(len(batch), bool))
        x = matrix(col.filter(ok), m.dims) if m.dims else np.zeros((0, 0), np.int64)
        k = m.components.shape[1]
        w = m.project(x) if len(x) else np.zeros((0, k))
        place = np.cumsum(ok.to_numpy(zero_copy_only=False)) - 1
        take = pa.array(place, pa.int64(), mask=~ok.to_numpy(zero_copy_only=False))
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(w.ravel()))
        return [(m.deviations(x) if len(x) else pa.array([], pa.decimal128(38, 0))).take(take), arrays.take(take)]

    return add_columns(df, {"deviation": "decimal(38,0)", "whitened": "array<double>"}, run).where(F.col("whitened").isNotNull())
