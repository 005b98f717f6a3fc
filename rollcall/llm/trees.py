"""Small trees in numpy: boosted for scores, single for decisions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in breadth-first order; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[node]
            inner = np.nonzero(f >= 0)[0]
            if not len(inner):
                return self.value[node]
            at = node[inner]
            node[inner] = 2 * at + 1 + (x[inner, f[inner]] > self.cut[at])


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: float = 1.0, ridge: float = 1.0,
         bins: int = 32) -> Tree:
    """A tree by second-order gain over quantile cuts of each feature."""
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c) for q, c in zip(cuts, x.T)], axis=1)
    node = np.zeros(len(x), np.int64)
    for n in range(size):
        here = np.nonzero(node == n)[0]
        if not len(here):
            continue
        g, h = grad[here], hess[here]
        value[n] = -g.sum() / (h.sum() + ridge)
        if n >= size // 2:
            continue
        best = (1e-9, -1, 0)
        for f, q in enumerate(cuts):
            if not len(q):
                continue
            gl = np.cumsum(np.bincount(code[here, f], g, len(q) + 1))[:-1]
            hl = np.cumsum(np.bincount(code[here, f], h, len(q) + 1))[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
            gain[(hl < least) | (hr < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] >= 0:
            feature[n], cut[n] = best[1], cuts[best[1]][best[2]]
            node[here] = 2 * n + 1 + (x[here, best[1]] > cut[n])
    return Tree(feature, cut, value)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Boosted:
    """Gradient-boosted trees for the log-odds of a label."""

    base: float
    rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2) -> Boosted:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model, z = Boosted(float(np.log(share / (1 - share))), rate, []), np.zeros(len(y))
    z += model.base
    for _ in range(rounds):
        p = sigmoid(z)
        model.trees.append(grow(x, p - y, p * (1 - p), depth, least=0.1))
        z += rate * model.trees[-1].predict(x)
    return model


def decide(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """A decision tree: the value of a leaf is above 0 where label 1 prevails."""
    return grow(x, 0.5 - y, np.full(len(y), 0.25), depth, least=0.2, ridge=0.01)


@dataclass
class Isotonic:
    """A rising step line through scores, straight between the steps."""

    at: np.ndarray
    value: np.ndarray

    def predict(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.at, self.value)


def isotonic(z: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pool also holds half a row of either label."""
    at, where = np.unique(z, return_inverse=True)
    pools: list[list[float]] = []  # [sum of y, rows, first, last]
    for v, n, s in zip(at, np.bincount(where), np.bincount(where, y)):
        pools.append([s, n, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s1, n1, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s1, pools[-1][1] + n1, pools[-1][2], last]
    level = [(s + 0.5) / (n + 1) for s, n, _, _ in pools]
    level = np.maximum.accumulate(level)
    return Isotonic(np.array([v for p in pools for v in p[2:]]), np.repeat(level, 2))
