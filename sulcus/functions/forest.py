"""Classification trees of two classes with exact splits, grown level by level: what a task does for its trees of a forest."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Rows of a forest, at most: a node, a rank, and how often a row of which class was drawn share one number of 63 bits.
ROWS = 1 << 20


class Tree(NamedTuple):
    """feature is -1 in leaves; left is the first child, the second follows it; share is class 1's; gain is by feature, in all 1 (or 0)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    share: np.ndarray
    gain: np.ndarray


class Ranks(NamedTuple):
    """Ranks of values by feature [features, rows], all features' distinct values one after another, and where each feature's start."""

    of: np.ndarray
    values: np.ndarray
    start: np.ndarray


def ranks(x: np.ndarray) -> Ranks:
    """x: rows by features."""
    parts = [np.unique(c, return_inverse=True) for c in x.T]
    of = np.array([p[1].ravel() for p in parts], np.int32).reshape(x.shape[1], len(x))
    return Ranks(of, np.concatenate([p[0] for p in parts]), np.cumsum([0, *[len(p[0]) for p in parts]])[:-1])


def some_features(nodes: int, features: int, tries: int, rng: np.random.Generator) -> np.ndarray:
    """`tries` different features for each node, every set as likely (Floyd's draws)."""
    out = np.empty((nodes, tries), np.int64)
    for k, top in enumerate(range(features - tries, features)):
        drawn = rng.integers(0, top + 1, nodes)
        out[:, k] = np.where((out[:, :k] == drawn[:, None]).any(1), top, drawn)
    return out


class _Best:
    """Each node's best cut so far: what it leaves mixed, its feature, the ranks on both sides, and the copies on the left by class."""

    def __init__(self, nodes: int):
        self.mixed, self.feature = np.full(nodes, np.inf), np.full(nodes, -1, np.int64)
        self.low, self.high, self.copies = (np.zeros(nodes, np.int64) for _ in range(3))
        self.varied = np.zeros(nodes, bool)  # some feature tried has two values


class _Rows(NamedTuple):
    """Different rows drawn.  key: of a feature and a row (one after another), rank and kind; kind: what the last `bits` of a key say, as copies."""

    key: np.ndarray
    bits: int
    copies: np.ndarray
    n: int


def _drawn(x: Ranks, y: np.ndarray, times: np.ndarray) -> tuple[_Rows, np.ndarray]:
    """And the copies of class 1 (upper half) and 0 of each row."""
    bag = np.flatnonzero(times)
    kind = 2 * times[bag] + y[bag]
    bits = int(kind.max()).bit_length()
    every = np.arange(1 << bits)
    copies = np.where(every % 2 == 1, every // 2 << 32, every // 2)
    return _Rows(((x.of[:, bag].astype(np.int64) << bits) | kind).ravel(), bits, copies, len(bag)), copies[kind]


def _search(best: _Best, nodes: np.ndarray, of: np.ndarray, d: _Rows, rows: np.ndarray, seg: np.ndarray, size: np.ndarray, have: np.ndarray, weights: np.ndarray, leaf: int, shift: int) -> None:
    """Tries features `of` [nodes, tries].  rows lie in nodes[seg]; size and have: rows and copies of a node; shift: to a node in a key.

    For weights l0, l1 on the left and r0, r1 on the right, the weighted impurity of both sides is twice l0 l1 / (l0 + l1) + r0 r1 / (r0 + r1).
    """
    count = size - 2 * leaf + 1  # places of a cut
    first = np.cumsum(count) - count
    start = np.cumsum(size) - size
    inner = np.arange(count.sum()) + np.repeat(start + leaf - 1 - first, count)
    before = np.repeat(np.cumsum(have) - have, count)
    t0, t1 = (np.repeat(v * w, count) for v, w in zip((have & 0xFFFFFFFF, have >> 32), weights))
    node = seg << shift
    for f in of.T:
        key = d.key[(f * d.n)[seg] + rows]
        key |= node
        key.sort()
        left = np.cumsum(d.copies[key & (len(d.copies) - 1)])[inner]
        left -= before
        key >>= d.bits
        best.varied[nodes] |= key[start] != key[start + size - 1]
        l0, l1 = (left & 0xFFFFFFFF) * weights[0], (left >> 32) * weights[1]
        r0, r1 = t0 - l0, t1 - l1
        mixed = l0 * l1 / (l0 + l1) + r0 * r1 / (r0 + r1)
        mixed[(key[1:] == key[:-1])[inner]] = np.inf
        top = np.minimum.reduceat(mixed, first)
        better = np.flatnonzero(top < best.mixed[nodes])
        if not len(better):
            continue
        hit = np.flatnonzero(mixed == np.repeat(top, count))
        hit = hit[np.searchsorted(hit, first[better])]
        which = nodes[better]
        best.mixed[which], best.feature[which], best.copies[which] = top[better], f[better], left[hit]
        ranks_only = (1 << shift - d.bits) - 1
        best.low[which], best.high[which] = key[inner[hit]] & ranks_only, key[inner[hit] + 1] & ranks_only


def grow(x: Ranks, y: np.ndarray, weights: np.ndarray, depth: int, split: int, leaf: int, tries: int, rng: np.random.Generator) -> Tree:
    """A tree over as many rows as there are, drawn with repeats.  weights: of classes 0 and 1.

    `split` and `leaf` count different rows.  A node tries `tries` features, and further ones while those tried are constant in it.
    """
    features, n = x.of.shape
    d, copies = _drawn(x, y, np.bincount(rng.integers(0, n, n), minlength=n))
    shift = n.bit_length() + d.bits
    rows, seg, size, have = np.arange(d.n), np.zeros(d.n, np.int64), np.array([d.n]), np.array([copies.sum()])
    levels, gain, made = [], np.zeros(features), 1
    for level in range(depth + 1):
        nodes = len(size)
        ones, zeros = have >> 32, have & 0xFFFFFFFF
        sums = np.stack([zeros * weights[0], ones * weights[1]])
        feature, cut, left = np.full(nodes, -1, np.int64), np.zeros(nodes), np.zeros(nodes, np.int64)
        levels.append((feature, cut, left, sums[1] / sums.sum(0)))
        divisible = (size >= max(split, 2 * leaf)) & (ones > 0) & (zeros > 0) & (level < depth)
        if not divisible.any():
            break
        best = _Best(nodes)
        at = np.flatnonzero(divisible)
        of = some_features(len(at), features, tries, rng)
        mine = divisible[seg]
        rows, seg = rows[mine], seg[mine]
        _search(best, at, of, d, rows, (np.cumsum(divisible) - 1)[seg], size[at], have[at], weights, leaf, shift)
        flat = np.flatnonzero(~best.varied[at])
        if len(flat) and tries < features:
            order = rng.random((len(flat), features))
            np.put_along_axis(order, of[flat], -1.0, 1)
            order, at = order.argsort(1), at[flat]
            for k in range(tries, features):
                still = ~best.varied[at]
                if not still.any():
                    break
                at, order = at[still], order[still]
                number = np.full(nodes, -1)
                number[at] = np.arange(len(at))
                mine = number[seg] >= 0
                _search(best, at, order[:, k : k + 1], d, rows[mine], number[seg[mine]], size[at], have[at], weights, leaf, shift)
        cutting = best.feature >= 0
        at = np.flatnonzero(cutting)
        if not len(at):
            break
        f = best.feature[at]
        low, high = (x.values[x.start[f] + v[at]] for v in (best.low, best.high))
        with np.errstate(invalid="ignore", over="ignore"):
            middle = low / 2 + high / 2
            feature[at], cut[at], left[at] = f, np.where(np.isfinite(middle) & (middle > low) & (middle < high), middle, low), made + 2 * np.arange(len(at))
        made += 2 * len(at)
        gain += np.bincount(f, np.maximum(sums[:, at].prod(0) / sums[:, at].sum(0) - best.mixed[at], 0.0), features)
        mine = cutting[seg]
        rows, seg = rows[mine], seg[mine]
        seg = 2 * (np.cumsum(cutting) - 1)[seg] + (d.key[(best.feature * d.n)[seg] + rows] >> d.bits > best.low[seg])
        size = np.bincount(seg, minlength=2 * len(at))
        have = np.stack([best.copies[at], have[at] - best.copies[at]], 1).ravel()
    parts = [np.concatenate(v) for v in zip(*levels)]
    return Tree(*parts, gain / gain.sum() if gain.sum() > 0 else np.zeros(features))


def shares(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Class 1's share in the leaf of each row; x: features by rows.  What is not at most the cut, NaN too, goes right."""
    n = x.shape[1]
    flat, node, at = x.ravel(), np.zeros(n, np.int64), np.arange(n)
    while len(at):
        f = tree.feature[node[at]]
        at, f = at[f >= 0], f[f >= 0]
        here = node[at]
        node[at] = tree.left[here] + ~(flat[f * n + at] <= tree.cut[here])
    return tree.share[node]


def judged(x: np.ndarray, y: np.ndarray, weights: np.ndarray, test: np.ndarray, trees: range, seed: int, depth: int, split: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over trees of the shares of test rows, and of the features' gains.  A tree's draws follow from the seed and its number."""
    r, t = ranks(x), np.ascontiguousarray(test.T)
    score, gain = np.zeros(len(test)), np.zeros(x.shape[1])
    for k in trees:
        tree = grow(r, y, weights, depth, split, leaf, max(1, int(x.shape[1] ** 0.5)), np.random.default_rng([seed % (1 << 63), k]))
        score += shares(tree, t)
        gain += tree.gain
    return score, gain
