"""Vector kernels in numpy: autocorrelation, log-space smoothing, symmetric products."""

from __future__ import annotations

import numpy as np

SIGMA, WINDOW, POINTS = 0.1, 5.0, 10.0


def separations(valid: np.ndarray) -> np.ndarray:
    """How many pairs of valid entries lie at each separation."""
    n = len(valid)
    if not n:
        return np.zeros(0)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(valid.astype(float), size)
    return np.round(np.fft.irfft(f * f.conj(), size)[:n])


def thinned(xs: np.ndarray, step: float) -> np.ndarray:
    """Points at least a factor 10**step apart, with the first and the last."""
    if not len(xs):
        return xs
    keep, factor = [0], 10.0**step
    while (k := int(np.searchsorted(xs, xs[keep[-1]] * factor, "right"))) < len(xs):
        keep.append(k)
    if xs[keep[-1]] != xs[-1]:
        keep.append(len(xs) - 1)
    return xs[keep]


def interpolated(xs: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Straight lines between knots in log-log space; ends are held, and knots keep their values."""
    with np.errstate(all="ignore"):
        lx, lk, lf = np.log(xs), np.log(knots), np.log(values)
        j = np.clip(np.searchsorted(lk, lx, "right") - 1, 0, len(lk) - 1)
        k = np.minimum(j + 1, len(lk) - 1)
        line = np.exp(lf[j] + (lx - lk[j]) / (lk[k] - lk[j]) * (lf[k] - lf[j]))
        out = np.where(np.isfinite(lk[j]), line, np.exp(lf[k]))
        out = np.where(lk[j] == lx, np.exp(lf[j]), out)
        out = np.where(lx <= lk[0], np.exp(lf[0]), out)
        return np.where(lx >= lk[-1], np.exp(lf[-1]), out)


def smoothed(xs: np.ndarray, *curves: np.ndarray) -> list[np.ndarray]:
    """Gaussian means of the curves over log10(xs), taken on thinned points and interpolated."""
    if not len(xs):
        return [np.zeros(0) for _ in curves]
    at = thinned(xs, SIGMA / POINTS)
    with np.errstate(divide="ignore"):
        logs, centres = np.log10(xs), np.log10(at)
    out = [np.zeros(len(at)) for _ in curves]
    lo, hi = np.searchsorted(logs, centres - SIGMA * WINDOW), np.searchsorted(logs, centres + SIGMA * WINDOW)
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
        if a < b:
            w = np.exp(-((centres[i] - logs[a:b]) ** 2) / (2 * SIGMA**2))
            if (total := w.sum()) > 0:
                for o, c in zip(out, curves):
                    o[i] = (c[a:b] * w).sum() / total
    return [interpolated(xs, at, o) for o in out]


def symmetric_product(i: np.ndarray, j: np.ndarray, count: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A v for the symmetric matrix whose upper triangle is given; the diagonal counts once."""
    off = i != j
    return np.bincount(i, count * v[j], len(v)) + np.bincount(j[off], count[off] * v[i[off]], len(v))
