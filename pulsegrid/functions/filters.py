"""Linear signal operators as matrices, designed once on the driver for a window length.

Detrending, zero-phase band-pass filtering, integration and the periodogram are linear, so a chain of them
over a window of T samples is one constant matrix.  Queries multiply by it inside an aggregation.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def detrend_matrix(t: int, smoothness: float = 100.0) -> np.ndarray:
    """I - (I + s^2 D'D)^-1 with D the second difference."""
    d = np.diff(np.eye(t), 2, axis=0)
    return np.eye(t) - np.linalg.inv(np.eye(t) + smoothness**2 * d.T @ d)


def butter_bandpass(order: int, low: float, high: float, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth band-pass (b, a): analogue prototype, band transform, bilinear map."""
    warp = 2 * fps * np.tan(np.pi * np.array([low, high]) / fps)
    width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    half = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    poles = np.concatenate([half + np.sqrt(half**2 - centre**2), half - np.sqrt(half**2 - centre**2)])
    zeros = np.zeros(order)
    gain = width**order * np.real(np.prod(2 * fps - zeros) / np.prod(2 * fps - poles))
    z = np.concatenate([(2 * fps + zeros) / (2 * fps - zeros), -np.ones(order)])
    return gain * np.real(np.poly(z)), np.real(np.poly((2 * fps + poles) / (2 * fps - poles)))


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state in which a constant input of one gives a constant output."""
    n = len(a) - 1
    companion = np.eye(n, k=1)
    companion[:, 0] -= a[1:]
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    y = np.empty_like(x)
    for i in range(len(x)):
        y[i] = b[0] * x[i] + state[0]
        state = np.vstack([state[1:], np.zeros((1, x.shape[1]))]) + b[1:, None] * x[i] - a[1:, None] * y[i]
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward along axis 0, odd extension, started in the steady state."""
    x = np.asarray(x, float)
    flat = x.reshape(len(x), -1)
    pad, zi = 3 * max(len(a), len(b)), _steady(b, a)[:, None]
    if len(x) <= pad:
        raise ValueError(f"a window of {len(x)} samples is too short for a padding of {pad}")
    wide = np.vstack([2 * flat[0] - flat[pad:0:-1], flat, 2 * flat[-1] - flat[-2 : -pad - 2 : -1]])
    there = _filtered(b, a, wide, zi * wide[0])
    back = _filtered(b, a, there[::-1], zi * there[-1])[::-1]
    return back[pad:-pad].reshape(x.shape)


def filtfilt_matrix(t: int, order: int, low: float, high: float, fps: float) -> np.ndarray:
    return filtfilt(*butter_bandpass(order, low, high, fps), np.eye(t))


def finishing_matrix(t: int, band: tuple[float, float], fps: float) -> np.ndarray:
    """Detrending, then a first-order band-pass: what the plane-orthogonal extractor does to its pulse."""
    return filtfilt_matrix(t, 1, *band, fps) @ detrend_matrix(t)


def next_power_of_2(t: int) -> int:
    return 1 if t == 0 else 1 << (t - 1).bit_length()


def band_bins(t: int, fps: float, low: float = 0.75, high: float = 2.5) -> np.ndarray:
    """Periodogram bins inside the band."""
    n = next_power_of_2(t)
    k = np.arange(n // 2 + 1)
    return k[(k * fps / n >= low) & (k * fps / n <= high)]


@lru_cache(maxsize=16)
def rate_weights(t: int, fps: float, cumulative: bool = False, detrended: bool = False, filtered: bool = False, own_band: tuple[float, float] | None = None) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """In-band bins and the (bins x t) real and imaginary weights of the whole chain; before it, with own_band, an extractor's own detrending and band-pass."""
    chain = finishing_matrix(t, own_band, fps) if own_band else np.eye(t)
    if cumulative:
        chain = np.cumsum(chain, axis=0)
    if detrended:
        chain = detrend_matrix(t) @ chain
    if filtered:
        chain = filtfilt_matrix(t, 1, 0.75, 2.5, fps) @ chain
    bins = band_bins(t, fps)
    wave = np.exp(-2j * np.pi * np.outer(bins, np.arange(t)) / next_power_of_2(t)) @ chain
    return tuple(int(k) for k in bins), np.ascontiguousarray(wave.real), np.ascontiguousarray(wave.imag)
