"""Numeric filter kernels on arrays (channels x samples), plain numpy."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, cutoff_hz: float, rate_hz: float, kind: str = "highpass") -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth coefficients by the bilinear transform."""
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warped = 2 * rate_hz * np.tan(np.pi * cutoff_hz / rate_hz)
    if kind == "highpass":
        poles, zeros = warped / poles, np.zeros(order)
    else:
        poles, zeros = warped * poles, np.zeros(0)
    fs2 = 2 * rate_hz
    z = (fs2 + zeros) / (fs2 - zeros)
    p = (fs2 + poles) / (fs2 - poles)
    z = np.concatenate([z, -np.ones(order - len(zeros))]) if len(zeros) < order else z
    b, a = np.real(np.poly(z)), np.real(np.poly(p))
    at = 1.0 if kind == "lowpass" else -1.0  # unit gain at DC or at half the rate
    return b * np.polyval(a, at) / np.polyval(b, at), a


def _state_space(b: np.ndarray, a: np.ndarray):
    n = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, n + 1 - len(b))) / a[0], np.pad(a, (0, n + 1 - len(a))) / a[0]
    m = np.zeros((n, n))
    m[:, 0] = -a[1:]
    m[:-1, 1:] = np.eye(n - 1)
    return m, b[1:] - a[1:] * b[0], b[0]


def lfilter(b, a, x: np.ndarray, state: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Causal IIR filter along the last axis, block by block in state-space form; returns output and last state."""
    m, g, d = _state_space(np.asarray(b, float), np.asarray(a, float))
    x = np.atleast_2d(np.asarray(x, float))
    n, (chans, nt) = len(g), x.shape
    s = np.zeros((chans, n)) if state is None else state.astype(float)
    size = min(block, max(nt, 1))
    powers = [np.eye(n)]
    for _ in range(size):
        powers.append(m @ powers[-1])
    seen = np.stack([p[0] for p in powers[:size]])  # output of a state after k samples
    impulse = np.concatenate([[d], [powers[k][0] @ g for k in range(size - 1)]])
    lag = np.arange(size)[None, :] - np.arange(size)[:, None]
    toeplitz = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    reach = np.stack([powers[size - 1 - k] @ g for k in range(size)])
    out = np.empty_like(x)
    for t in range(0, nt, size):
        xb = x[:, t : t + size]
        w = xb.shape[1]
        out[:, t : t + w] = xb @ toeplitz[:w, :w] + s @ seen[:w].T
        s = s @ powers[w].T + xb @ reach[size - w :]
    return out, s


def filtfilt(b, a, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter: forward and backward with odd extension and settled start."""
    x = np.atleast_2d(np.asarray(x, float))
    pad = min(3 * max(len(a), len(b)), x.shape[1] - 1)
    if pad > 0:
        left = 2 * x[:, :1] - x[:, pad:0:-1]
        right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
        ext = np.concatenate([left, x, right], axis=1)
    else:
        ext = x
    m, g, _ = _state_space(np.asarray(b, float), np.asarray(a, float))
    zi = np.linalg.solve(np.eye(len(g)) - m, g)
    y, _ = lfilter(b, a, ext, ext[:, :1] * zi[None, :])
    y = y[:, ::-1]
    y, _ = lfilter(b, a, y, y[:, :1] * zi[None, :])
    y = y[:, ::-1]
    return y[:, pad : pad + x.shape[1]] if pad > 0 else y


def sinc_kernels(factor: int, taps: int = 12, delay: float = 0.0) -> np.ndarray:
    """One Hamming-windowed sinc per output phase, ``taps + 1`` long, shifted by phase / factor plus a channel delay in samples."""
    n = np.arange(taps + 1) - taps / 2
    window = np.hamming(taps + 1)
    return np.stack([window * np.sinc(n - k / factor - delay) for k in range(factor)])


def resample(x: np.ndarray, factor: int, taps: int = 12, delays: np.ndarray | None = None) -> np.ndarray:
    """Upsample by an integer factor: ``nt * factor - factor + 1`` outputs (T5). Samples outside count as 0."""
    x = np.atleast_2d(np.asarray(x, float))
    chans, nt = x.shape
    half = taps // 2
    padded = np.pad(x, ((0, 0), (half, half)))
    views = np.lib.stride_tricks.sliding_window_view(padded, taps + 1, axis=1)
    out = np.empty((chans, nt * factor))
    for c in range(chans):
        k = sinc_kernels(factor, taps, 0.0 if delays is None else float(delays[c]))
        out[c] = (views[c] @ k.T).ravel()
    return out[:, : nt * factor - factor + 1]


def sample_hold_delays(ad_chans, rate_hz: float, clock_hz: float = 1e6) -> np.ndarray:
    """Delay in samples of each converter channel: (channel mod 32) ticks of the master clock."""
    return (np.asarray(ad_chans) % 32) / clock_hz * rate_hz


def daubechies(moments: int) -> np.ndarray:
    """Scaling filter with the given vanishing moments, by spectral factorisation."""
    from math import comb

    y = np.array([comb(moments - 1 + k, k) for k in range(moments)][::-1], float)
    z: list[complex] = []
    for r in np.roots(y):  # each root y gives z + 1/z = 2 - 4y; keep the one inside the circle
        b = 1 - 2 * r
        pair = [b + np.sqrt(b * b - 1 + 0j), b - np.sqrt(b * b - 1 + 0j)]
        z.append(min(pair, key=abs))
    h = np.real(np.poly([-1.0] * moments + z))
    return h / h.sum() * np.sqrt(2)


def _mirror(x: np.ndarray, n: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (n, n)), mode="symmetric")


def wavelet_highpass(x: np.ndarray, level: int = 6, moments: int = 4) -> np.ndarray:
    """Multilevel wavelet decomposition with the approximation removed (T3): cutoff near rate / 2 / 2**level."""
    x = np.atleast_2d(np.asarray(x, float))
    lo = daubechies(moments)
    hi = lo[::-1] * (-1.0) ** np.arange(len(lo))
    n = len(lo)
    conv = lambda a, f: np.stack([np.convolve(r, f) for r in a])
    sizes, details, a = [], [], x
    for _ in range(level):
        e = _mirror(a, n - 1)
        sizes.append(a.shape[1])
        details.append(conv(e, hi[::-1])[:, n : -n + 1 or None : 2])
        a = conv(e, lo[::-1])[:, n : -n + 1 or None : 2]
    a = np.zeros_like(a)
    for d, size in zip(details[::-1], sizes[::-1], strict=True):
        k = min(a.shape[1], d.shape[1])
        up = np.zeros((2, x.shape[0], 2 * k))
        up[0, :, ::2], up[1, :, ::2] = a[:, :k], d[:, :k]
        a = (conv(up[0], lo) + conv(up[1], hi))[:, n - 2 : n - 2 + size]
    return a


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    x = np.atleast_2d(np.asarray(x, float))
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1))


def rectified_envelope(x: np.ndarray, rate_hz: float, cutoff_hz: float = 300.0, order: int = 4) -> np.ndarray:
    """Rectify and low-pass without phase shift."""
    b, a = butterworth(order, cutoff_hz, rate_hz, "lowpass")
    return filtfilt(b, a, np.abs(x))


def lower_median(x: np.ndarray) -> np.ndarray:
    """The smaller of the two middle values along the last axis."""
    k = (x.shape[-1] - 1) // 2
    return np.partition(x, k, axis=-1)[..., k]


def sharpness(x: np.ndarray) -> np.ndarray:
    """Sharpness at each sample of (channels x samples); 0 where there is no peak of a closed segment."""
    x = np.atleast_2d(np.asarray(x, float))
    out = np.zeros_like(x)
    for c, row in enumerate(x):
        turn = np.flatnonzero(np.diff(row > 0)) + 1
        for a, b in zip(turn[:-1], turn[1:], strict=False):
            k = a + int(np.argmax(np.abs(row[a:b])))
            out[c, k] = row[k] * abs(row[k]) / (b - a)
    return out
