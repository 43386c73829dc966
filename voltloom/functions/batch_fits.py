"""Least squares for many rows at once: Levenberg-Marquardt with analytic derivatives.

All rows of a batch take a step together; every row has its own damping and
stops by itself, and rows that have stopped leave the batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: (parameters, rows still moving) to the model's values and derivatives there.
Model = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def levenberg(model: Model, start: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, steps: int = 100, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters (rows x k), squared error, and whether each row settled.

    ``model(p, rows)`` gives values (r x m) and derivatives (r x m x k) for the
    parameters of ``rows``; ``weight`` (rows x m) is zero where a row has no value.
    """
    p = np.array(start, float)
    weight = np.ones_like(target, float) if weight is None else weight.astype(float)
    n, k = p.shape
    live = np.arange(n)

    def at(q, rows):
        f, j = model(q, rows)
        r = (f - target[rows]) * weight[rows]
        return r, j * weight[rows][:, :, None], (r * r).sum(1)

    r, j, cost = at(p, live)
    damp, settled = np.full(n, 1e-3), ~np.isfinite(cost)
    bad = settled.copy()  # rows whose start is no number stay as they are and do not count as settled
    live, r, j = live[~bad], r[~bad], j[~bad]
    for _ in range(steps):
        if not len(live):
            break
        g = np.einsum("rmk,rm->rk", j, r)
        h = np.einsum("rmk,rml->rkl", j, j)
        diag = np.maximum(np.einsum("rkk->rk", h), 1e-12)
        a = h + (damp[live][:, None] * diag)[:, :, None] * np.eye(k)
        step = -np.linalg.solve(a, g[:, :, None])[:, :, 0]
        new = p[live] + step
        r2, j2, c2 = at(new, live)
        better = np.isfinite(c2) & (c2 <= cost[live])
        small = (np.abs(step).max(1) <= 1e-8 * (1 + np.abs(new).max(1))) | (cost[live] - c2 <= tol * (cost[live] + 1e-300))
        done = (better & small) | (damp[live] > 1e12)
        p[live[better]], cost[live[better]] = new[better], c2[better]
        r[better], j[better] = r2[better], j2[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 4, 1e-12), damp[live] * 4)
        settled[live[done]] = True
        live, r, j = live[~done], r[~done], j[~done]
    return p, cost, settled & ~bad


def two_gaussians(t: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> Model:
    """Sum of two Gaussians at fixed times over common sample times ``t``, and an offset: V0, V1, s0, s1, offset."""

    def model(p, rows):
        v0, v1, s0, s1, off = (p[:, k : k + 1] for k in range(5))
        x0, x1 = t - t0[rows, None], t - t1[rows, None]
        g0, g1 = np.exp(-(x0**2) / (2 * s0**2)), np.exp(-(x1**2) / (2 * s1**2))
        return v0 * g0 + v1 * g1 + off, np.stack([g0, g1, v0 * g0 * x0**2 / s0**3, v1 * g1 * x1**2 / s1**3, np.ones_like(g0)], -1)

    return model


#: Free parameters of the spatial fits, as places in (x0, y0, sx, sy), two where they move together; and whether x counts.
SPATIAL = {
    "x0y0s_sym": ([(0,), (1,), (2, 3)], True),
    "x0y0_sym": ([(0,), (1,)], True),
    "x0y0": ([(0,), (1,)], True),
    "s": ([(2, 3)], True),
    "sxsy": ([(2,), (3,)], True),
    "y0": ([(1,)], False),
    "sy": ([(2, 3)], False),
}


def spatial_model(kind: str, fixed: np.ndarray, height: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """A Gaussian of fixed height over sites: free parameters by ``kind``, the others (x0, y0, sx, sy) from ``fixed``."""
    free, wide = SPATIAL[kind]

    def model(p, rows):
        q = fixed[rows].copy()
        for k, places in enumerate(free):
            q[:, places] = p[:, k : k + 1]
        x0, y0, sx, sy = (q[:, k : k + 1] for k in range(4))
        dx, dy = (x[rows] - x0) * wide, y[rows] - y0
        f = height[rows, None] * np.exp(-(dx**2) / (2 * sx**2) - dy**2 / (2 * sy**2))
        full = np.stack([f * dx / sx**2, f * dy / sy**2, f * dx**2 / sx**3, f * dy**2 / sy**3], -1)
        return f, np.stack([full[:, :, list(places)].sum(-1) for places in free], -1)

    return model


def fit_spatial(kind: str, start: np.ndarray, height: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x0, y0, sx, sy) of every row, its squared error, and whether it settled; widths are positive."""
    free, _ = SPATIAL[kind]
    p, cost, settled = levenberg(spatial_model(kind, start, height, x, y), np.stack([start[:, places[0]] for places in free], 1), w, mask)
    out = start.copy()
    for k, places in enumerate(free):
        out[:, list(places)] = p[:, k : k + 1]
    out[:, 2:] = np.abs(out[:, 2:])
    return out, cost, settled
