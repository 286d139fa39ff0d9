"""Histogram gradient-boosted trees in numpy, kept as flat arrays.

All trees stand in one set of arrays (feature, threshold, left, right, value). A
leaf points at itself, so scoring is ``depth`` rounds of gathers for all rows of a
batch at once, without a branch for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 8) -> Forest:
    """Logistic loss, second-order gains over histograms of at most ``bins`` bins a feature.

    No rows: every score is 0.5. Rows of one class only: every score is near that class's share.
    """
    n, width = x.shape if len(x) else (0, max(1, x.shape[1] if x.ndim == 2 else 1))
    share = (y.sum() + 1.0) / (n + 2.0)
    feature, threshold, left, right, value, roots = [0], [np.inf], [0], [0], [0.0], []
    base = float(np.log(share / (1 - share))) if n else 0.0
    if n and 0 < y.sum() < n:
        edges = [_edges(x[:, f], bins) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        offset = np.arange(width) * bins
        flat = binned + offset
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            at = np.zeros(n, int)
            root = len(feature)
            roots.append(root)
            for new in (feature, threshold, left, right, value):
                new.append(0)
            threshold[root], left[root], right[root] = np.inf, root, root
            live = {0: root}
            nodes = np.full(n, root)
            for _level in range(depth):
                k = len(live)
                slot = {node: i for i, node in enumerate(live.values())}
                lut = np.full(len(feature), -1)
                for node, i in slot.items():
                    lut[node] = i
                rows = np.flatnonzero(lut[nodes] >= 0)
                if not len(rows):
                    break
                keys = (lut[nodes[rows]][:, None] * (width * bins) + flat[rows]).ravel()
                size = k * width * bins
                hg = np.bincount(keys, np.repeat(g[rows], width), size).reshape(k, width, bins).cumsum(2)
                hh = np.bincount(keys, np.repeat(h[rows], width), size).reshape(k, width, bins).cumsum(2)
                hn = np.bincount(keys, minlength=size).reshape(k, width, bins).cumsum(2)
                tg, th, tn = hg[:, :, -1:], hh[:, :, -1:], hn[:, :, -1:]
                gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
                gain[(hn < least) | (tn - hn < least)] = -1
                live = {}
                for node, i in slot.items():
                    f, b = divmod(int(gain[i].argmax()), bins)
                    if gain[i, f, b] <= 1e-6 or b >= len(edges[f]):
                        continue
                    feature[node], threshold[node] = f, float(edges[f][b])
                    left[node], right[node] = len(feature), len(feature) + 1
                    for _side in range(2):
                        me = len(feature)
                        feature.append(0), threshold.append(np.inf), left.append(me), right.append(me), value.append(0.0)
                        live[len(live)] = me
                    mine = nodes == node
                    nodes[mine] = np.where(binned[mine, f] <= b, left[node], right[node])
                if not live:
                    break
            sg, sh = np.bincount(nodes, g, len(feature)), np.bincount(nodes, h, len(feature))
            for node in np.unique(nodes):
                value[node] = float(-rate * sg[node] / (sh[node] + l2))
            margin += np.asarray(value)[nodes]
            del at
    return Forest(np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value), np.array(roots, int), depth, base)
