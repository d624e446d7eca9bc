"""Context-tree weighting over binary-decomposed bytes, from counts.

A byte is eight binary decisions; each decision (a prefix of the byte's bits) has a context tree of its own over
the preceding bytes. A node's Krichevsky-Trofimov block probability depends on its two counts alone,
and its weighted probability is the mean of that and of its children's product, so a tree is made
bottom-up from a table of counts, in any order of the training data. The probability of a byte then is
read off along its context's path: at each depth the node's own estimate and the next depth's are mixed with
the posterior weight of stopping there.

A context and the byte after it are one 64-bit number, the nearest byte of the context first:
contexts that share a suffix are neighbours in sorted order, and the nodes of a subtree are a range.
"""

from __future__ import annotations

import numpy as np

DEPTH = 6
_TABLE = 1 << 16
_half: np.ndarray | None = None


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _half
    if _half is None:
        n = np.arange(_TABLE - 1)
        half = np.concatenate(([0.0], np.cumsum(np.log(n + 0.5))))  # ln gamma(n + 1/2) - ln gamma(1/2)
        one = np.concatenate(([0.0], np.cumsum(np.log(n + 1.0))))  # ln gamma(n + 1)
        _half = np.stack((half, one))
    return _half[0], _half[1]


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a sequence with a zeros and b ones."""
    half, one = _tables()

    def at(table: np.ndarray, n: np.ndarray, shift: float, base: float) -> np.ndarray:
        out = table[np.minimum(n, _TABLE - 1)]
        big = n >= _TABLE
        if big.any():
            out[big] = _stirling(n[big] + shift) - base
        return out

    return at(half, a, 0.5, 0.5723649429247001) + at(half, b, 0.5, 0.5723649429247001) - at(one, a + b, 1.0, 0.0)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of a sorted key, and each entry's run."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Level:
    """The nodes of one depth: for each of the eight bits, counts and weights by (context, bits so far)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams = grams  # (context << 8 | byte), sorted, distinct
        self.counts = counts
        self.bits = []
        for k in range(8):
            first, run = _groups(grams >> np.uint64(8 - k))  # node: context and the k bits so far
            one = ((grams >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            b = np.add.reduceat(np.where(one, counts, 0), first) if len(first) else np.zeros(0, np.int64)
            n = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            self.bits.append((run, one, n - b, b))


def levels(grams: np.ndarray, counts: np.ndarray, depth: int, least: int = 0) -> list[tuple[Level, np.ndarray]]:
    """For each depth from `depth` to `least`: its nodes and each entry's place in the next shallower one."""
    out = []
    level = Level(grams, counts)
    for d in range(depth, least, -1):
        # drop the farthest byte of the context
        byte = level.grams & np.uint64(255)
        short = (level.grams >> np.uint64(16)) << np.uint64(8) | byte
        order = np.argsort(short, kind="stable")
        first, run = _groups(short[order])
        up = np.empty(len(order), np.int64)
        up[order] = run
        out.append((level, up))
        level = Level(short[order][first], np.add.reduceat(level.counts[order], first) if len(first) else level.counts)
    out.append((level, np.arange(len(level.grams))))
    return out


def weighted(tree: list[tuple[Level, np.ndarray]]) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """For each depth and bit the posterior weight of stopping at the nodes; the last depth's ln of the
    weighted probabilities."""
    stop, below, up_below = [], None, None
    for i, (level, up) in enumerate(tree):
        now, stops = [], []
        for k in range(8):
            run, _, a, b = level.bits[k]
            own = kt_block(a, b)
            if below is None:
                now.append(own)
                stops.append(np.ones(len(own)))
                continue
            deep, deep_run = below[k], tree[i - 1][0].bits[k][0]
            first = np.flatnonzero(np.concatenate(([True], deep_run[1:] != deep_run[:-1]))) if len(deep_run) else np.zeros(0, np.int64)
            kids = np.bincount(run[up_below[first]], weights=deep, minlength=len(own))
            top, stopping = _weight(own, kids)
            stops.append(stopping)
            now.append(top)
        stop.append(stops)
        below, up_below = now, up
    return stop, below


def predicted(tree, stop) -> np.ndarray:
    """ln of the probability of each entry's byte in its context."""
    return np.log(mixed_bits(tree, stop)).sum(axis=0)


def mixed_bits(tree, stop) -> np.ndarray:
    """For each of the eight bits and each entry of the deepest level the mixed probability of the bit."""
    size = len(tree[0][0].grams)
    place = np.arange(size)
    p = np.empty((8, size))
    for i, (level, up) in enumerate(tree):
        for k in range(8):
            run, one, a, b = level.bits[k]
            own = (np.where(one, b[run], a[run]) + 0.5) / (a[run] + b[run] + 1.0)
            if i == 0:
                p[k] = own
            else:
                w = stop[i][k][run]
                p[k] = (w * own)[place] + (1 - w)[place] * p[k]
        place = up[place]
    return p


def _weight(own: np.ndarray, kids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the nodes' weighted probabilities, and the posterior weight of stopping there."""
    top = np.logaddexp(own, kids)
    return top - np.log(2.0), np.exp(own - top)


class Top:
    """The nodes of the two nearest bytes and above, from the summed roots of the subtrees below: sorted arrays over
    (two bytes, bit, bits so far) of nodes that are there, and dense ones over (nearest byte, bit, bits so far),
    256 * 8 * 128 nodes. log_w: the sum of the roots' weights, which are a node's children."""

    def __init__(self, sub: np.ndarray, bit: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, log_w: np.ndarray):
        name = (sub.astype(np.int64) * 8 + bit) * 128 + prefix
        order = np.argsort(name)
        self.name, self.a2, self.b2 = name[order], a[order], b[order]
        own = kt_block(self.a2, self.b2)
        log_w, self.stop2 = _weight(own, log_w[order])
        shape, n = (256, 8, 128), 256 * 8 * 128
        at = (self.name >> 18) << 10 | (self.name & 1023)
        total = lambda x: np.bincount(at, weights=x, minlength=n).reshape(shape)
        self.a1, self.b1, kids = total(self.a2.astype(np.float64)), total(self.b2.astype(np.float64)), total(log_w)
        own = kt_block(self.a1.astype(np.int64), self.b1.astype(np.int64))
        top, self.stop1 = _weight(own, kids)
        self.a0, self.b0 = self.a1.sum(axis=0), self.b1.sum(axis=0)
        own = kt_block(self.a0.astype(np.int64), self.b0.astype(np.int64))
        there = np.bincount(at, minlength=n).reshape(shape) > 0
        kids = top.sum(axis=0, where=there)
        self.stop0 = _weight(own, kids)[1]

    def mixed(self, near: np.ndarray, byte: np.ndarray, p: np.ndarray) -> np.ndarray:
        """ln of the bytes' probabilities after the two nearest bytes, from the bits' probabilities p (8, n) at the
        subtrees' roots."""
        out = np.zeros(len(byte))
        nearest = near >> 8
        for k in range(8):
            prefix = byte >> (8 - k)
            one = (byte >> (7 - k)) & 1 > 0
            at = np.searchsorted(self.name, (near * 8 + k) * 128 + prefix)
            q = p[k]
            for a, b, w in (
                (self.a2[at], self.b2[at], self.stop2[at]),
                (self.a1[nearest, k, prefix], self.b1[nearest, k, prefix], self.stop1[nearest, k, prefix]),
                (self.a0[k, prefix], self.b0[k, prefix], self.stop0[k, prefix]),
            ):
                q = w * (np.where(one, b, a) + 0.5) / (a + b + 1) + (1 - w) * q
            out += np.log(q)
        return out


def grams_of(data: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """(context << 8 | byte) at each byte of the strings between bounds; a context ends at its string's start."""
    out = np.zeros((len(data), 8), np.uint8)
    out[:, 0] = data
    for back in range(1, min(depth, len(data) - 1) + 1):
        out[back:, depth - back + 1] = data[:-back]  # the nearest byte stands highest
    for i in range(depth):
        at = bounds[:-1] + i
        out[at[at < bounds[1:]], 1 : depth - i + 1] = 0
    return out.view("<u8").ravel()
