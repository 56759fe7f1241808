"""Small models trained on the driver from bounded samples: boosted trees, isotonic calibration, paired logistic loss."""

from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, number: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, number + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]


def _digits(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1) if x.shape[1] else np.zeros((len(x), 0), int)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, ridge: float = 1.0) -> dict:
    """Gradient-boosted trees of a fixed depth for logistic loss, by histograms of features."""
    edges = _bins(x, bins)
    d, n, k = _digits(x, edges), len(x), x.shape[1]
    width = bins + 1
    p0 = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, start)
    features, cuts, values = [], [], []
    flat = d + np.arange(k) * width
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, int)
        f_of, c_of = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            many = 1 << level
            key = (node[:, None] * (k * width) + flat).ravel()
            gs = np.bincount(key, np.repeat(g, k), many * k * width).reshape(many, k, width).cumsum(2)
            hs = np.bincount(key, np.repeat(h, k), many * k * width).reshape(many, k, width).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < least) | (h_all - hs < least)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for j in range(many):
                f, b = divmod(int(best[j]), width)
                i = many - 1 + j
                f_of[i] = f
                c_of[i] = edges[f][b] if gain[j, f, b] > 1e-9 and b < len(edges[f]) else np.inf
            i = many - 1 + node
            node = node * 2 + (x[np.arange(n), f_of[i]] > c_of[i])
        g_leaf, h_leaf = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        leaf = rate * g_leaf / (h_leaf + ridge)
        margin += leaf[node]
        features.append(f_of)
        cuts.append(c_of)
        values.append(leaf)
    return {"start": start, "depth": depth, "features": np.array(features, int).reshape(-1, 2**depth - 1), "cuts": np.array(cuts).reshape(-1, 2**depth - 1), "values": np.array(values).reshape(-1, 2**depth)}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for f, c, v in zip(model["features"], model["cuts"], model["values"]):
        node = np.zeros(len(x), int)
        for level in range(model["depth"]):
            i = (1 << level) - 1 + node
            node = node * 2 + (x[rows, f[i]] > c[i])
        out += v[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing scores and the calibrated share of ones at each.

    Two end points with `prior` rows' weight keep shares off 0 and 1 where few rows speak.
    """
    order = np.argsort(score, kind="stable")
    s, v = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, weight, last score
    for k, (a, b) in enumerate(zip(s.tolist(), v.tolist())):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and (blocks[-2][2] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            total, weight, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, last]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    mean = float(v.mean())
    level = np.array([(t + prior * mean * 0.5) / (w + prior * 0.5) for t, w, _ in blocks])
    return np.array([b[2] for b in blocks]), np.maximum.accumulate(level)


def calibrated(fit: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    at, level = fit
    return np.clip(level[np.minimum(np.searchsorted(at, score, "left"), len(at) - 1)], 0.0, 1.0)


def paired_logistic(diff: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights that minimise log(1 + exp(-w.d)) over preferred-minus-other rows d, by Newton's method."""
    n, k = diff.shape
    w = np.zeros(k)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(diff @ w)).mean() + ridge * (w @ w) / 2) if n else 0.0

    now = loss(w)
    for _ in range(steps if n else 0):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        grad = -(diff.T @ p) / n + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        if now - new < 1e-9:
            break
        w, now = w - size * step, new
    return w
