"""Hashed word and character n-gram features, and the two linear models trained on them in numpy.

Features of a text come in groups (character 2/3/4-grams, words, word pairs).
Each feature has a bucket; a text is the mean over its features, group by
group, so long and short texts are on one scale.  ``Features.counts`` gives
sparse per-row counts for training, ``Features.score`` the per-row sums of a
bucket table for scoring.  Scoring never cuts a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gradelens.llm import text as T

U64 = np.uint64


@dataclass(frozen=True)
class Features:
    """Which features a text has and how many buckets each group gets (``1 << bits``).

    ``fold``: bytes as they are lower-cased and stripped to letters (language),
    else raw bytes with case and symbols (quality).  ``words``: also words and
    word pairs; a word equal to its predecessor has one bucket of its own, so
    that repetition is a feature whatever the word.
    """

    bits: int = 15
    orders: tuple[int, ...] = (2, 3, 4)
    fold: bool = True
    words: bool = False

    @property
    def groups(self) -> int:
        return len(self.orders) + 2 * self.words

    @property
    def size(self) -> int:
        return self.groups << self.bits

    def _bucket(self, code: np.ndarray, group: int) -> np.ndarray:
        h = (code * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)
        return h.astype(np.int64) + (group << self.bits)

    def parts(self, data: np.ndarray, at: np.ndarray):
        """For each group: (bucket of each feature, pointer of each row's features)."""
        if self.fold:
            kind = T.byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
            code = np.where(kind, T.LOWER, 32).astype(np.uint8)[data]
        else:
            kind = T.NOT_SPACE
            code = np.where(kind, np.arange(256), 32).astype(np.uint8)[data]
        wide, n = code.astype(np.uint64), len(code)
        gap = code == 32
        row_end = np.zeros(n, bool)
        ends = at[1:][at[1:] > at[:-1]]
        row_end[ends - 1] = True
        for g, k in enumerate(self.orders):
            m = max(n - k + 1, 0)
            packed = np.zeros(m, U64)
            ok = np.ones(m, bool)
            for j in range(k):
                packed |= wide[j:j + m] << U64(8 * j)
                if 0 < j < k - 1:          # a gap only at the edges: n-grams stay within one word
                    ok &= ~gap[j:j + m]
                if j < k - 1:
                    ok &= ~row_end[j:j + m]
            if k == 2:
                ok &= ~(gap[:m] & gap[1:1 + m])
            first = np.flatnonzero(ok)
            yield self._bucket(packed[first] + U64(k), g), np.searchsorted(first, at)
        if self.words:
            starts, _, ptr, h = T.words_of(data, at, kind, lower=self.fold)
            yield self._bucket(h, len(self.orders)), ptr
            pairs, first = T.shingle_hashes(h, ptr, 2)
            same = h[first] == h[first + 1] if len(first) else np.zeros(0, bool)
            pairs[same] = U64(0)
            yield self._bucket(pairs, len(self.orders) + 1), np.searchsorted(first, ptr)

    def counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text (buckets, weights); the weights of a group add up to 1 / groups."""
        out = []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            at = np.array([0, len(data)])
            idx, val = [], []
            for bucket, _ in self.parts(data, at):
                if len(bucket):
                    u, c = np.unique(bucket, return_counts=True)
                    idx.append(u)
                    val.append(c / (c.sum() * self.groups))
            out.append((np.concatenate(idx) if idx else np.zeros(0, np.int64),
                        np.concatenate(val) if val else np.zeros(0)))
        return out

    def score(self, table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows x classes: the mean of ``table``'s entries over each row's features, group by group."""
        rows, classes = len(at) - 1, table.shape[1]
        out = np.zeros((rows, classes))
        for bucket, ptr in self.parts(data, at):
            n = np.maximum(np.diff(ptr), 1) * self.groups
            for c in range(classes):
                out[:, c] += T.row_sums(table[:, c][bucket], ptr) / n
        return out


def batches(n: int, size: int, rng: np.random.Generator):
    order = rng.permutation(n)
    for lo in range(0, n, size):
        yield order[lo:lo + size]


def _dense(rows: list[tuple[np.ndarray, np.ndarray]], take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    idx = np.concatenate([rows[i][0] for i in take])
    val = np.concatenate([rows[i][1] for i in take])
    own = np.repeat(np.arange(len(take)), [len(rows[i][0]) for i in take])
    return idx, val, own


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_embeddings(rows, labels: np.ndarray, size: int, classes: int, dim: int = 12, epochs: int = 8,
                     rate: float = 0.5, batch: int = 16, seed: int = 11, weights: np.ndarray | None = None):
    """Averaged bucket embeddings with a linear softmax, by stochastic gradient descent (Adagrad steps).

    Returns (table, bias): embeddings times output weights, so that scoring adds one number per class and feature.
    The mean over features has small entries, hence the fixed gain on the averaged vector.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (size, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    g_emb, g_out, g_bias = np.full(size, 1e-6, np.float32), np.full_like(out, 1e-6), np.full(classes, 1e-6, np.float32)
    gain = 20.0
    weights = np.ones(len(labels)) if weights is None else weights
    target = np.eye(classes, dtype=np.float32)[labels]
    for _ in range(epochs):
        for take in batches(len(rows), batch, rng):
            idx, val, own = _dense(rows, take)
            if not len(idx):
                continue
            used, inv = np.unique(idx, return_inverse=True)
            x = np.zeros((len(take), len(used)), np.float32)
            x[own, inv] = val * gain
            hidden = x @ emb[used]
            p = softmax(hidden @ out + bias)
            d = (p - target[take]) * weights[take, None].astype(np.float32) / len(take)
            d_out, d_hidden = hidden.T @ d, d @ out.T
            d_emb = x.T @ d_hidden
            g_out += d_out ** 2
            g_bias += d.sum(0) ** 2
            g_emb[used] += (d_emb ** 2).mean(1)
            out -= rate * 0.2 * d_out / np.sqrt(g_out)
            bias -= rate * 0.2 * d.sum(0) / np.sqrt(g_bias)
            emb[used] -= rate * 0.2 * d_emb / np.sqrt(g_emb[used])[:, None]
    return (gain * emb @ out).astype(np.float32), bias.astype(np.float64)


def train_logistic(rows, labels: np.ndarray, size: int, epochs: int = 10, rate: float = 0.5, batch: int = 16,
                   l2: float = 1e-6, seed: int = 13, weights: np.ndarray | None = None):
    """Logistic regression on hashed features by stochastic gradient descent (Adagrad steps): (table, bias)."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(size), 0.0
    g_w, g_b = np.full(size, 1e-8), 1e-8
    gain = 20.0
    weights = np.ones(len(labels)) if weights is None else weights
    for _ in range(epochs):
        for take in batches(len(rows), batch, rng):
            idx, val, own = _dense(rows, take)
            z = np.bincount(own, w[idx] * val * gain, len(take)) + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]) * weights[take] / len(take)
            used, inv = np.unique(idx, return_inverse=True)
            grad = np.bincount(inv, val * gain * d[own], len(used)) + l2 * w[used]
            g_w[used] += grad ** 2
            g_b += d.sum() ** 2
            w[used] -= rate * grad / np.sqrt(g_w[used])
            b -= rate * d.sum() / np.sqrt(g_b)
    return (gain * w).astype(np.float32)[:, None], np.array([b])


def platt(margin: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that make ``1 / (1 + exp(-(a * margin + b)))`` a probability.

    Newton steps with halving on the log loss against smoothed targets, on margins of unit spread.
    """
    spread = max(float(margin.std()), 1e-6)
    x = margin / spread
    pos, neg = labels.sum(), (1 - labels).sum()
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(v):
        z = v[0] * x + v[1]
        return (np.logaddexp(0, z) - t * z).mean() + 1e-4 * v @ v

    v = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -30, 30)))
        g = np.array([((p - t) * x).mean(), (p - t).mean()]) + 2e-4 * v
        s = p * (1 - p)
        h = np.array([[(s * x * x).mean(), (s * x).mean()], [(s * x).mean(), s.mean()]]) + 2e-4 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(v - size * step) > loss(v):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(v[0], 1e-3) / spread), float(v[1])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, from a fixed grid."""
    grid = np.geomspace(0.2, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
