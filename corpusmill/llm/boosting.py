"""Gradient-boosted trees with logistic loss on quantile bins, for small bounded samples; numpy only."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Binary classifier; deterministic. ``fit`` on a bounded sample, ``logits`` anywhere.

    Each tree sees ``share`` of the rows, drawn anew with a fixed seed.
    """

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, least: float = 2.0, ridge: float = 1.0, share: float = 0.5) -> None:
        self.trees, self.depth, self.rate, self.least, self.ridge, self.share = trees, depth, rate, least, ridge, share
        self.cuts: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins, n, rng = self._binned(x), len(y), np.random.default_rng(7)
        mean = float((y * weight).sum() / weight.sum())
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        for _ in range(self.trees):
            rows = np.flatnonzero(rng.random(n) < self.share)
            p = 1 / (1 + np.exp(-score[rows]))
            g, h = weight[rows] * (y[rows] - p), weight[rows] * p * (1 - p)
            self.nodes.append(self._tree(bins[rows], g, h))
            score += self.rate * self._values(bins, self.nodes[-1])
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, width_all = (1 << (self.depth + 1)) - 1, b.shape[1]
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        at = np.zeros(len(b), np.int64)
        for level in range(self.depth + 1):
            first, width = (1 << level) - 1, 1 << level
            live = np.flatnonzero(at >= first)
            local = at[live] - first
            gl_, hl_ = g[live], h[live]
            value[first : first + width] = np.bincount(local, gl_, width) / (np.bincount(local, hl_, width) + self.ridge)
            if level == self.depth:
                break
            best = np.full(width, 1e-6)
            for j in range(width_all):
                cell = local * BINS + b[live, j]
                gs, hs = (np.bincount(cell, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (gl_, hl_))
                gl, hl = gs[:, :-1], hs[:, :-1]
                gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                gain[(hl < self.least) | (hr < self.least)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better], cut[first : first + width][better] = j, k[better]
            split = feature[at[live]] >= 0
            moved = live[split]
            where = at[moved]
            at[moved] = 2 * where + 1 + (b[moved, feature[where]] > cut[where])
        return feature, cut, value

    def _values(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + self.rate * sum((self._values(b, t) for t in self.nodes), np.zeros(len(x)))

    def to_dict(self) -> dict:
        return {"depth": self.depth, "rate": self.rate, "base": self.base, "cuts": [c.tolist() for c in self.cuts], "nodes": [[a.tolist() for a in t] for t in self.nodes]}

    @classmethod
    def from_dict(cls, kept: dict) -> Boosted:
        model = cls(trees=len(kept["nodes"]), depth=kept["depth"], rate=kept["rate"])
        model.base, model.cuts = kept["base"], [np.array(c) for c in kept["cuts"]]
        model.nodes = [(np.array(f), np.array(c), np.array(v)) for f, c, v in kept["nodes"]]
        return model
