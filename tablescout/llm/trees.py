"""Gradient-boosted trees with monotonic constraints, grown and scored on numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth as flat node arrays, row per tree.

    Node ``i`` sends values above ``cut[i]`` of ``feature[i]`` to ``2 i + 2`` and others to ``2 i + 1``.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _best_split(g, h, low, high, signs, ridge, least):
    """Split of one node with the largest gain: (feature, bin, left value, right value), or None.

    ``g, h`` are sums of gradients and curvatures for (feature, bin); values stay within the node's bounds and
    rise (sign 1) or fall (sign -1) with a constrained feature.
    """
    gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    g_all, h_all = g[0].sum(), h[0].sum()
    gr, hr = g_all - gl, h_all - hl
    left, right = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
    own = np.clip(-g_all / (h_all + ridge), low, high)

    def worth(g, h, v):
        return -(g * v + 0.5 * (h + ridge) * v * v)

    gain = worth(gl, hl, left) + worth(gr, hr, right) - worth(g_all, h_all, own)
    allowed = (hl >= least) & (hr >= least) & (signs[:, None] * (right - left) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return (f, b, left[f, b], right[f, b]) if gain[f, b] > 1e-9 else None


def grown(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
          bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost ``trees`` trees for the log loss of 0/1 labels ``y``; ``signs`` (-1, 0, 1) constrain the features."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    logit, inner = np.full(n, start), 2**depth - 1
    features, cuts, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    slot = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        value, bounds = np.zeros(2 * inner + 1), np.tile([-np.inf, np.inf], (2 * inner + 1, 1))
        value[0] = -g.sum() / (h.sum() + ridge)
        for node in range(inner):
            value[2 * node + 1 : 2 * node + 3] = value[node]
            bounds[2 * node + 1 : 2 * node + 3] = bounds[node]
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            cells = (binned[rows] + slot).ravel()
            sums = [np.bincount(cells, np.repeat(v[rows], width), width * bins).reshape(width, bins) for v in (g, h)]
            found = _best_split(*sums, *bounds[node], signs, ridge, least)
            if found is None:
                at[rows] = 2 * node + 1
                continue
            f, b, left, right = found
            features[t, node], cuts[t, node] = f, edges[f][b] if b < len(edges[f]) else np.inf
            value[2 * node + 1], value[2 * node + 2] = left, right
            if signs[f]:
                middle, up = (left + right) / 2, signs[f] > 0
                bounds[2 * node + 1, int(up)] = middle
                bounds[2 * node + 2, int(not up)] = middle
            at[rows] = 2 * node + 1 + (binned[rows, f] > b)
        leaves[t] = rate * value[inner:]
        logit += leaves[t][at - inner]
    return Trees(features, cuts, leaves, start)
