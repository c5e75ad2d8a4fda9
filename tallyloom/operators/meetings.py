"""Pairs of sets that may be similar enough: the kernel of operators.similarity, over arrays of one cell of sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Sets of a cell are compared by classes of sizes within this ratio.
RATIO = 1.105
#: Counters in memory at once, and meetings of tokens.
COUNTERS, MEETINGS = 4_000_000, 4_000_000
#: Keys from here on are of frequent tokens, by rising frequency; below, of rare ones, by hash.
FREQUENT = 1 << 31


def needed(n, m, least: float):
    """How many tokens sets of sizes n and m share at least if their Jaccard similarity is `least`."""
    return np.ceil((n + m) * (least / (1 + least)) - 1e-9).astype(np.int64)


def smallest(n, least: float):
    """The smallest size of a set that similar to one of size n."""
    return np.ceil(np.asarray(n) * least - 1e-9).astype(np.int64)


def asked(n):
    """How many tokens two prefixes are asked to share, where the smaller set has n: more take longer prefixes, but hardly ever meet by chance."""
    return 3 + np.asarray(n) // 15


def prefix_length(n, least: float):
    """Tokens of a set of size n that any partner may ask for."""
    n = np.asarray(n, np.int64)
    return np.minimum(n, n - needed(n, smallest(n, least), least) + asked(n))


def order_keys(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """32-bit keys that put rare tokens first. Tokens that share one are met once too often, never missed."""
    keys = (hashes.view(np.uint64) & np.uint64(FREQUENT - 1)).astype(np.uint32)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hit = frequent[at] == hashes
        keys[hit] = FREQUENT + rank[at[hit]].astype(np.uint32)
    return keys


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start and count."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def runs(counts: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive pieces (a, b) of at most `rows` items whose counts add up to `most`, or of one item."""
    total, at = np.append(0, np.cumsum(counts)), 0
    while at < len(counts):
        to = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + most, "right")) - 1))
        yield at, to
        at = to


class Cell:
    """Sets by size and by the keys of their prefixes: doc i has keys[off[i]:off[i + 1]], in rising order."""

    def __init__(self, n: np.ndarray, off: np.ndarray, keys: np.ndarray, least: float):
        self.n, self.off, self.keys, self.least = n.astype(np.int64), off.astype(np.int64), keys, least
        distinct, self.token = np.unique(keys, return_inverse=True)
        self.tokens = len(distinct)

    def pairs(self, x: np.ndarray, y: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a set of x and one of y that may be similar enough; without y, of two of x, each once."""
        other = x if y is None else y
        level = np.floor(np.log(np.maximum(self.n, 1)) / math.log(RATIO)).astype(np.int64)
        for i in np.unique(level[x]):
            for j in np.unique(level[other]):
                if y is None and j > i:
                    continue
                for a, b in self.compared(x[level[x] == i], other[level[other] == j]):
                    if y is None and i == j:
                        a, b = a[a > b], b[a > b]
                    yield self.refined(a, b)

    def compared(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that share as many tokens of their prefixes as they would at least, if they were similar."""
        nx, ny, least = self.n[x], self.n[y], self.least
        if ny.max() < smallest(nx.min(), least) or nx.max() < smallest(ny.min(), least):
            return
        ask = int(min(asked(min(nx.min(), ny.min())), needed(nx.min(), ny.min(), least)))
        entries = lambda own, n, m: np.minimum(n - needed(n, np.maximum(m, smallest(n, least)), least) + ask, np.diff(self.off)[own])
        px, py = entries(x, nx, ny.min()), entries(y, ny, nx.min())
        ytoken, ydoc = self.token[spread(self.off[y], py)], np.repeat(np.arange(len(y)), py)
        ydoc = ydoc[np.argsort(ytoken, kind="stable")]
        count = np.bincount(ytoken, minlength=self.tokens)
        start = np.cumsum(count) - count
        xtoken, xdoc = self.token[spread(self.off[x], px)], np.repeat(np.arange(len(x)), px)
        met = count[xtoken]
        xtoken, xdoc, met = xtoken[met > 0], xdoc[met > 0], met[met > 0]
        first = np.searchsorted(xdoc, np.arange(len(x) + 1))
        of_doc = np.bincount(xdoc, met, len(x)).astype(np.int64)
        for a, b in runs(of_doc, MEETINGS, max(1, COUNTERS // len(y))):
            shared = 0
            for s, e in runs(met[first[a] : first[b]], MEETINGS, 1 << 60):
                own = slice(first[a] + s, first[a] + e)
                at = np.repeat((xdoc[own] - a) * len(y), met[own]) + ydoc[spread(start[xtoken[own]], met[own])]
                shared = shared + np.bincount(at, minlength=(b - a) * len(y))
            if np.ndim(shared):
                hit = np.flatnonzero(shared >= ask)
                yield x[a + hit // len(y)], y[hit % len(y)]

    def refined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs that could be similar by all that is shared of both prefixes, and the rest of the one that ends earlier."""
        small, large = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        fits = small >= smallest(large, self.least)
        a, b, out = a[fits], b[fits], []
        length = np.diff(self.off)
        for s, e in runs(length[a] + length[b], MEETINGS, 1 << 60):
            p, q = a[s:e], b[s:e]
            code = np.concatenate([(np.repeat(np.arange(len(d), dtype=np.uint64), length[d]) << np.uint64(32)) | self.keys[spread(self.off[d], length[d])] for d in (p, q)])
            code.sort()
            twice = code[1:][code[1:] == code[:-1]]
            shared = np.bincount((twice >> np.uint64(32)).astype(np.int64), minlength=len(p))
            lastp, lastq = self.keys[self.off[p + 1] - 1], self.keys[self.off[q + 1] - 1]
            rest = np.where(lastp < lastq, self.n[p] - length[p], self.n[q] - length[q])
            # Where both end at one key, tokens that share it may stand on either side of the end.
            rest = np.where(lastp == lastq, np.maximum(rest, self.n[p] - length[p]) + 1, rest)
            out.append(shared + rest >= needed(self.n[p], self.n[q], self.least))
        keep = np.concatenate(out) if out else np.zeros(0, bool)
        return a[keep], b[keep]
