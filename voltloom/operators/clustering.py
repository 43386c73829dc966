"""Features and clustering: components, gradient-ascent clustering, sub-clustering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(df: DataFrame, vec: str, k: int = 5, out: str = "pc") -> DataFrame:
    """Principal components of centred vectors (F2).

    The mean and the d x d second moments are sums over tasks, so only a matrix
    of the vector's width reaches the driver; the projection is a column.
    """
    x = df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))

    def moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in it:
            if len(pdf):
                a = np.stack(pdf["v"].to_numpy())
                a = np.concatenate([a, np.ones((len(a), 1))], axis=1)
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel()]})

    parts = x.mapInPandas(moments, "m array<double>")
    rows = parts.select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    d = int(round(len(rows) ** 0.5))
    m = np.array([r["x"] for r in rows]).reshape(d, d)
    n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    w, vecs = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    top = vecs[:, np.argsort(-w)[:k]]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])  # the largest loading is positive
    cols = []
    for j in range(top.shape[1]):
        w_j = F.array(*[F.lit(float(c)) for c in top[:, j]])
        dot = F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), w_j, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        cols.append((dot - float(mean @ top[:, j])).alias(f"{out}{j}"))
    return df.select("*", *cols)


def fast_ica(x: np.ndarray, k: int, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """Symmetric FastICA with the log-cosh contrast on whitened data, components by falling negentropy."""
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    k = min(k, int((s > 1e-10 * s[0]).sum()))
    z = u[:, :k] * np.sqrt(len(x))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = np.tanh(z @ w.T)
        new = g.T @ z / len(z) - np.diag((1 - g**2).mean(0)) @ w
        a, _, b = np.linalg.svd(new)
        new = a @ b
        if np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-8:
            w = new
            break
        w = new
    y = z @ w.T
    gauss = 0.374567207  # expectation of log cosh of a standard normal
    return y[:, np.argsort(-((np.log(np.cosh(y)).mean(0) - gauss) ** 2))]


def nmf(x: np.ndarray, k: int = 5, seed: int = 0, rounds: int = 300) -> np.ndarray:
    """Non-negative factors by multiplicative updates; x is shifted to be non-negative."""
    x = x - min(0.0, float(x.min()))
    r = np.random.default_rng(seed)
    w, h = r.random((len(x), k)) + 1e-3, r.random((k, x.shape[1])) + 1e-3
    for _ in range(rounds):
        h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
        w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
    return w


@dataclass(frozen=True)
class Ascent:
    """Parameters of gradient-ascent clustering."""

    sigma: float = 0.4
    merge: float = 0.25
    reach: float = 4.0
    alpha: float = 2.0
    most_gradient: int = 1000
    least_points: int = 5
    still: float = 1e-5
    most_quiet: int = 1000
    rounds: int = 2000


def ascend(points: np.ndarray, p: Ascent | None = None) -> np.ndarray:
    """Cluster numbers by falling size, -1 for small clusters.

    Every point starts a scout. In each round scouts closer than
    ``merge * sigma`` merge, the lower one in order of the first dimension
    staying, and every moving scout climbs to the Gaussian-weighted mean of the
    original points within ``reach * sigma``, thinned evenly where the slab
    along the first dimension is crowded.
    """
    p = p or Ascent()
    x = np.asarray(points, float)
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(x[:, 0], kind="stable")
    data = x[order]
    scouts, owner = data.copy(), np.arange(n)
    alive = np.arange(n)
    frozen = np.zeros(n, bool)
    merge2, reach, still2 = (p.merge * p.sigma) ** 2, p.reach * p.sigma, (p.still * p.sigma * p.alpha) ** 2
    quiet = 0
    for _ in range(p.rounds):
        alive = alive[np.argsort(scouts[alive, 0], kind="stable")]
        s = scouts[alive]
        gone = np.zeros(len(alive), bool)
        ends = np.searchsorted(s[:, 0], s[:, 0] + p.merge * p.sigma, "right")
        for i in range(len(alive)):
            if gone[i] or ends[i] - i < 2:
                continue
            near = np.arange(i + 1, ends[i])
            near = near[~gone[near]]
            near = near[((s[near] - s[i]) ** 2).sum(1) <= merge2]
            if len(near):
                gone[near] = True
                owner[alive[near]] = alive[i]
                frozen[alive[i]] = False
        quiet = 0 if gone.any() else quiet + 1
        alive = alive[~gone]
        moving = alive[~frozen[alive]]
        if quiet >= p.most_quiet or not len(moving):
            break
        lo = np.searchsorted(data[:, 0], scouts[moving, 0] - reach, "left")
        hi = np.searchsorted(data[:, 0], scouts[moving, 0] + reach, "right")
        for k, a, b in zip(moving.tolist(), lo.tolist(), hi.tolist(), strict=True):
            some = data[a : b : max(1, (b - a) // p.most_gradient)]
            d = some - scouts[k]
            d2 = (d * d).sum(1)
            w = np.where(d2 <= reach * reach, np.exp(-d2 / (2 * p.sigma**2)), 0.0)
            total = w.sum()
            if total > 0:
                step = p.alpha * (w @ d) / total
                scouts[k] += step
                frozen[k] = step @ step < still2
            else:
                frozen[k] = True
    else:
        raise RuntimeError(f"clusters did not settle in {p.rounds} rounds")
    while (owner[owner] != owner).any():
        owner = owner[owner]
    roots, label, count = np.unique(owner, return_inverse=True, return_counts=True)
    rank = np.full(len(roots), -1)
    big = [k for k in np.lexsort((roots, -count)) if count[k] >= p.least_points]
    rank[big] = np.arange(len(big))
    out = np.empty(n, np.int64)
    out[order] = rank[label]
    return out


def cluster(df: DataFrame, by: list[str], key: str, dims: list[str], params: Ascent | None = None) -> DataFrame:
    """Gradient-ascent clusters within each partition of existing units (C4, C5): (by, key, cluster).

    A partition is one in-memory problem, as the method needs all its points;
    split units first where one holds more than fits a task.
    """
    p = params or Ascent()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*by, key]].copy()
        out["cluster"] = ascend(pdf[dims].to_numpy(float), p)
        return out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*by, key, *dims).groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in [*by, key]), "cluster long"]))


def components(df: DataFrame, by: list[str], key: str, vec: str, kind: str = "ica", k: int = 5, seed: int = 0) -> DataFrame:
    """ICA or NMF scores within each partition (F3, F5): (by, key, comp array<double>)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vec].to_numpy()).astype(float)
        y = fast_ica(x, min(k, x.shape[1], int(np.rint(np.sqrt(len(x))))), seed) if kind == "ica" else nmf(x, k, seed)
        out = pdf[[*by, key]].copy()
        out["comp"] = list(y)
        return out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*by, key, vec).groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in [*by, key]), "comp array<double>"]))
