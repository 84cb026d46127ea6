"""Empirical modes of one window of a signal, by sifting between spline envelopes."""

from __future__ import annotations

import numpy as np


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (x, y), evaluated at `at`."""
    n, h = len(x), np.diff(x)
    system, right = np.eye(n), np.zeros(n)
    i = np.arange(1, n - 1)
    system[i, i - 1], system[i, i], system[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    slope = np.diff(y) / h
    right[i] = 6 * np.diff(slope)
    m = np.linalg.solve(system, right)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = x[k + 1] - at, at - x[k]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b


def _envelope(v: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Spline through the peaks, which are mirrored at both ends."""
    last = len(v) - 1
    x = np.concatenate([-peaks[1::-1], peaks, 2 * last - peaks[:-3:-1]])
    x, first = np.unique(x, return_index=True)
    y = np.concatenate([v[peaks[1::-1]], v[peaks], v[peaks[:-3:-1]]])[first]
    return natural_spline(x.astype(float), y, np.arange(len(v), dtype=float))


def _extrema(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.sign(np.diff(v))
    return np.flatnonzero((d[:-1] > 0) & (d[1:] < 0)) + 1, np.flatnonzero((d[:-1] < 0) & (d[1:] > 0)) + 1


def modes(signal: np.ndarray, most: int = 3, rounds: int = 50, still: float = 0.2) -> list[np.ndarray]:
    """The first modes, the fastest first; none if the signal has too few extrema."""
    rest, found = np.asarray(signal, float), []
    while len(found) < most:
        v = rest.copy()
        high, low = _extrema(v)
        if len(high) < 2 or len(low) < 2:
            break
        for _ in range(rounds):
            mean = (_envelope(v, high) + _envelope(v, low)) / 2
            done = (mean**2).sum() < still * 0.01 * (v**2).sum()
            v = v - mean
            high, low = _extrema(v)
            if done or len(high) < 2 or len(low) < 2:
                break
        found.append(v)
        rest = rest - v
    return found
