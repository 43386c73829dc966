"""Least-squares fits of spatial Gaussians, and alignment of waveforms."""

from __future__ import annotations

import numpy as np


def levenberg(residual, start, steps: int = 60, tol: float = 1e-9) -> np.ndarray:
    """Damped Gauss-Newton with a numeric Jacobian, for one to three parameters."""
    p = np.asarray(start, float)
    r = residual(p)
    cost, damp = r @ r, 1e-3
    for _ in range(steps):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        j = np.stack([(residual(p + h[k] * np.eye(len(p))[k]) - r) / h[k] for k in range(len(p))], 1)
        g, n = j.T @ r, j.T @ j
        while True:
            try:
                step = -np.linalg.solve(n + damp * np.diag(np.diag(n) + 1e-12), g)
            except np.linalg.LinAlgError:
                return p
            new = residual(p + step)
            c = new @ new
            if c <= cost:
                break
            damp *= 4
            if damp > 1e12:
                return p
        done = cost - c <= tol * (cost + 1e-30) and np.abs(step).max() <= 1e-6 * (1 + np.abs(p).max())
        p, r, cost, damp = p + step, new, c, max(damp / 4, 1e-12)
        if done:
            break
    return p


def peak_weights(wave: np.ndarray, at: int, other: int | None = None, reach: int = 2) -> np.ndarray:
    """Per channel the peak-to-peak (or, without ``other``, the signed peak) near two samples."""
    sign = np.sign(wave[np.argmax(np.abs(wave[:, at])), at]) or 1.0

    def near(k, s):
        w = wave[:, max(0, k - reach) : k + reach + 1] * s
        return w.max(1)

    first = near(at, sign)
    if other is None:
        return np.maximum(first, 0) * sign
    return np.maximum(first + near(other, -sign), 0)


def spatial_mean(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Centroid by |w|; plain mean where all are 0."""
    a = np.abs(np.asarray(w, float))
    if a.sum() == 0:
        return float(np.mean(x)), float(np.mean(y))
    return float(a @ x / a.sum()), float(a @ y / a.sum())


def gaussian_1d(w, x, y, most_sigma: float = 200.0, start: float = 60.0):
    """Fit the width, then the depth, of a Gaussian along y with fixed height; None if too wide."""
    w, y = np.abs(np.asarray(w, float)), np.asarray(y, float)
    x0, y0 = spatial_mean(w, np.asarray(x, float), y)
    if len(w) < 2:
        return x0, y0, start, start
    top = w.max()
    s = abs(levenberg(lambda p: top * np.exp(-((y - y0) ** 2) / (2 * p[0] ** 2 + 1e-9)) - w, [start])[0])
    if not 0 < s <= most_sigma:
        return None
    moved = levenberg(lambda p: top * np.exp(-((y - p[0]) ** 2) / (2 * s**2)) - w, [y0])[0]
    return (x0, y0 if abs(moved - y0) > 3 * s else float(moved), s, s)


def gaussian_2d(w, x, y, most_sigma: float = 200.0, start: float = 60.0):
    """Fit a common width, then the position, of a round Gaussian; None if too wide."""
    w, x, y = np.abs(np.asarray(w, float)), np.asarray(x, float), np.asarray(y, float)
    x0, y0 = spatial_mean(w, x, y)
    if len(w) < 2:
        return x0, y0, start, start
    top = w.max()
    s = abs(levenberg(lambda p: top * np.exp(-((x - x0) ** 2 + (y - y0) ** 2) / (2 * p[0] ** 2 + 1e-9)) - w, [start])[0])
    if not 0 < s <= most_sigma:
        return None
    a, b = levenberg(lambda p: top * np.exp(-((x - p[0]) ** 2 + (y - p[1]) ** 2) / (2 * s**2)) - w, [x0, y0])
    if np.hypot(a - x0, b - y0) > 3 * s:
        a, b = x0, y0
    return float(a), float(b), s, s


LOCATORS = {"gaussian 1d": gaussian_1d, "gaussian 2d": gaussian_2d, "spatial mean": lambda w, x, y, most_sigma=0, start=60.0: (*spatial_mean(w, x, y), start, start)}


def shift_wave(wave: np.ndarray, n: int) -> np.ndarray:
    """Shift along the last axis, edge values repeated."""
    if n == 0:
        return wave.copy()
    out = np.roll(wave, n, axis=-1)
    if n > 0:
        out[..., :n] = wave[..., :1]
    else:
        out[..., n:] = wave[..., -1:]
    return out


def align_best(waves: np.ndarray, most: int = 2) -> np.ndarray:
    """Shift of each wave (spikes x channels x samples) that brings it closest to the mean; the first of equals."""
    waves = np.asarray(waves, float)
    mean = waves.mean(0)
    shifts = np.arange(-most, most + 1)
    cost = np.stack([((shift_wave(waves, int(s)) - mean) ** 2).sum((1, 2)) for s in shifts])
    return shifts[cost.argmin(0)]
