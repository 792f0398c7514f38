"""Hypergeometric draws of any size, many at once, by rejection.

The hypergeometric is log-concave, so a flat top around the mode with
exponential tails, scaled by the probability at the mode, covers it (Devroye
1987): about five tries per draw whether the urn holds ten balls or 10**15.
Probabilities come from saddle-point deviances (Loader 2000), which lose no
precision to the difference of large log-factorials.
"""

from __future__ import annotations

import numpy as np

_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)
#: ln k! minus Stirling's leading terms, for k = 0..15 (0 at k = 0 by convention)
_EXACT_REST = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 16))) - (
    (np.arange(1, 16) + 0.5) * np.log(np.arange(1, 16)) - np.arange(1, 16) + _HALF_LOG_2PI)))


def _rest(n: np.ndarray) -> np.ndarray:
    """ln n! minus Stirling's leading terms."""
    big = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * big * big)) / (big * big)) / (big * big)) / big
    return np.where(n < 16, _EXACT_REST[np.minimum(n, 15).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, by its series where the two are close."""
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
        v = (x - mean) / (x + mean)
    v = np.where(np.isfinite(v), v, 0.0)
    near = (x - mean) * v
    term, square = 2 * x * v, v * v
    for j in range(1, 9):
        term = term * square
        near = near + term / (2 * j + 1)
    return np.where(np.abs(v) < 0.1, near, far)


def _log_binomial(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln P(k of n) at success probability p, for 0 <= k <= n and 0 < p < 1."""
    rest = n - k
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = (_rest(n) - _rest(k) - _rest(rest) - _deviance(k, n * p) - _deviance(rest, n * (1 - p))
                 + 0.5 * np.log(n / (k * rest)) - _HALF_LOG_2PI)
        return np.where(k == 0, n * np.log1p(-p), np.where(rest == 0, n * np.log(p), inner))


def log_hypergeometric(k, good, bad, n) -> np.ndarray:
    """ln P(k good ones among n drawn); -inf outside the support. 0 < n < good + bad."""
    k, good, bad, n = (np.asarray(a, np.float64) for a in (k, good, bad, n))
    p = n / (good + bad)
    inside = (k >= 0) & (k <= good) & (n - k >= 0) & (n - k <= bad)
    j = np.where(inside, k, np.clip(np.minimum(good, n), 0, None))
    out = _log_binomial(j, good, p) + _log_binomial(n - j, bad, p) - _log_binomial(n, good + bad, p)
    return np.where(inside, out, -np.inf)


def hypergeometric(good, bad, n, rng):
    """Number of good balls among ``n`` drawn from ``good + bad`` without
    replacement; arrays give an array of draws, scalars an int."""
    scalar = np.ndim(good) == np.ndim(bad) == np.ndim(n) == 0
    good, bad, n = (a.ravel() for a in np.broadcast_arrays(*(np.atleast_1d(np.asarray(a, np.int64)) for a in (good, bad, n))))
    low, high = np.maximum(0, n - bad), np.minimum(good, n)
    out = high.copy()
    todo = np.flatnonzero(low < high)
    if len(todo):
        g, b, m = (a[todo].astype(np.float64) for a in (good, bad, n))
        mode = np.clip(np.floor((m + 1) / (g + b + 2) * (g + 1)), low[todo], high[todo])
        top = log_hypergeometric(mode, g, b, m)
        peak = np.exp(top)
        wide = 1 + peak / 2
        while len(todo):
            tries = max(1, min(16, 4096 // len(todo)))
            u, v, w, s = rng.random((4, tries, len(todo)))
            flat = u <= wide / (1 + wide)
            y = np.where(flat, v * wide, wide - np.log1p(-v)) / peak
            k = mode + np.where(s < 0.5, -1, 1) * np.floor(y + 0.5)
            took = np.log1p(-w) + np.minimum(0.0, wide - peak * y) <= log_hypergeometric(k, g, b, m) - top
            first, got = took.argmax(0), took.any(0)
            out[todo[got]] = k[first[got], np.flatnonzero(got)].astype(np.int64)
            todo, mode, top, peak, wide, g, b, m = (a[~got] for a in (todo, mode, top, peak, wide, g, b, m))
    return int(out[0]) if scalar else out


def multivariate_hypergeometric(counts, n, draws: int, rng) -> np.ndarray:
    """``draws`` rows: how many of ``n`` balls drawn (one number, or one per row)
    come from each count."""
    counts = np.asarray([int(c) for c in counts], np.int64)
    out = np.zeros((draws, len(counts)), dtype=np.int64)
    left = np.broadcast_to(np.asarray(n, np.int64), (draws,)).copy()
    after = counts.sum() - np.cumsum(counts)
    for i, c in enumerate(counts):
        out[:, i] = x = hypergeometric(np.full(draws, c), after[i], left, rng)
        left -= x
    return out
