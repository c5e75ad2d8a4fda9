"""A hashed linear scorer, trained by follow-the-regularised-leader on a bounded sample, or by descent on sums over all rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np

BUCKETS = 1 << 18
WORD = re.compile(r"[^\W_]+")


class Hasher:
    """Bucket numbers of a text's distinct lower-cased words; a word is hashed once."""

    def __init__(self, buckets: int = BUCKETS, most: int = 300_000):
        self.buckets, self.most, self.known = buckets, most, {}

    def of(self, name: str) -> int:
        if (found := self.known.get(name)) is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.buckets
        return found

    def starts(self, text: str | None, lengths: Sequence[int] = (4, 5)) -> np.ndarray:
        """Buckets of the distinct words and of the beginnings of longer ones, which inflected forms share."""
        found = set(WORD.findall((text or "").lower()))
        found |= {f"^{w[:n]}" for n in lengths for w in found if len(w) > n}
        return np.array(sorted({self.of(w) for w in found}), np.int64)

    def words(self, text: str | None) -> np.ndarray:
        return np.array(sorted({self.of(w) for w in set(WORD.findall((text or "").lower()))}), np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Linear:
    """Logistic weights over `buckets` presence features, `dense` real-valued ones and a bias."""

    def __init__(self, buckets: int, dense: int = 0):
        self.buckets, self.w = buckets, np.zeros(buckets + dense + 1, np.float64)

    def margin(self, index: np.ndarray, dense: Sequence[float] = ()) -> float:
        extra = self.w[self.buckets : self.buckets + len(dense)]
        return float(self.w[index].sum() + (extra * np.asarray(dense)).sum() + self.w[-1])

    def score(self, index: np.ndarray, dense: Sequence[float] = ()) -> float:
        return float(sigmoid(self.margin(index, dense)))

    def fit(self, index: list[np.ndarray], dense: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 16, alpha: float = 0.15, l1: float = 0.6, l2: float = 0.5, seed: int = 42) -> Linear:
        """Soft labels y in [0, 1]; rows in the order given, shuffled by the seed, so equal input gives equal weights."""
        z, n, w = np.zeros_like(self.w), np.zeros_like(self.w), self.w
        plain = np.arange(self.buckets, len(w))
        rng, k = np.random.default_rng(seed), dense.shape[1] if dense.ndim == 2 else 0
        for _ in range(epochs if len(y) else 0):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                cols = np.concatenate([index[i] for i in own])
                rows = np.repeat(np.arange(len(own)), [len(index[i]) for i in own])
                u, inv = np.unique(cols, return_inverse=True)
                m = np.bincount(rows, w[u][inv], len(own)) + w[-1]
                if k:
                    m = m + dense[own] @ w[self.buckets : self.buckets + k]
                off = sigmoid(m) - y[own]
                g = np.bincount(inv, off[rows], len(u))
                both = np.concatenate([u, plain])
                g = np.concatenate([g, dense[own].T @ off if k else [], [off.sum()]])
                step = (np.sqrt(n[both] + g * g) - np.sqrt(n[both])) / alpha
                z[both] += g - step * w[both]
                n[both] += g * g
                free = np.abs(z[both]) - np.where(both < self.buckets, l1, 0.0)
                w[both] = np.where(free > 0, -np.sign(z[both]) * free / (np.sqrt(n[both]) / alpha + l2), 0.0)
        return self


class Descent:
    """Limited-memory BFGS on a smooth convex sum, plus l2 / 2 for each squared weight; whoever asks for x tells the sum and its gradient there.

    `bend` bounds the sum's second derivatives from above by a diagonal, so the first step goes down; a later one that doesn't is halved.
    """

    def __init__(self, bend: np.ndarray, l2: float, pairs: int = 8):
        self.bend, self.l2, self.most, self.pairs = bend + l2, l2, pairs, []
        self.at, self.value, self.slope, self.way, self.step = np.zeros(len(bend)), np.inf, np.zeros(len(bend)), np.zeros(len(bend)), 1.0
        self.x = self.at

    def tell(self, value: float, slope: np.ndarray) -> None:
        value, slope = value + self.l2 / 2 * float(self.x @ self.x), slope + self.l2 * self.x
        if value > self.value + 1e-4 * self.step * float(self.slope @ self.way):
            self.step /= 2
            self.x = snapped(self.at + self.step * self.way)
            return
        move, turn = self.x - self.at, slope - self.slope
        if np.isfinite(self.value) and move @ turn > 1e-10:
            self.pairs = [*self.pairs, (move, turn)][-self.most :]
        self.at, self.value, self.slope, self.step = self.x, value, slope, 1.0
        way, used = -slope, []
        for move, turn in reversed(self.pairs):
            used.append((move @ way) / (move @ turn))
            way = way - used[-1] * turn
        way = way / self.bend
        if self.pairs:
            move, turn = self.pairs[-1]
            way *= (move @ turn) / (turn @ (turn / self.bend))
        for (move, turn), share in zip(self.pairs, reversed(used), strict=True):
            way = way + move * (share - (turn @ way) / (move @ turn))
        self.way = way
        self.x = snapped(self.at + way)


def snapped(w: np.ndarray, bits: int = 24) -> np.ndarray:
    """Weights as whole multiples of 2**-bits, whose sums are exact in any order."""
    return np.round(w * 2.0**bits) / 2.0**bits


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The threshold of highest F1 for y among the predictions; 0.5 if there is no positive.

    With n, a prediction stands for n examples, of which y are positive.
    """
    y, n = (y > 0.5, np.ones(len(p))) if n is None else (y, n)
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.cumsum(n[order]) + hit[-1])
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.where(last, f1, 0).argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)
