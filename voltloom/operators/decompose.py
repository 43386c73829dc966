"""Sparse principal components from mergeable moments (F4), and components kept as long as their members stay the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOMENTS = "k int, x double"


def moments(df: DataFrame, vec: str) -> DataFrame:
    """(k, x): sums of products of the vector's elements and a one, flat; a row per cell, whatever the number of rows.

    Rows whose vector is null take no part.  The sums of two tables add up to
    those of both (``merged``), so a batch that arrives is one pass over itself.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in it:
            if len(pdf):
                a = np.column_stack([np.stack(pdf["v"].to_numpy()), np.ones(len(pdf))])
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pd.DataFrame({"k": np.arange(total.size, dtype=np.int32), "x": total.ravel()})

    rows = df.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    return merged(rows.mapInPandas(run, MOMENTS))


def merged(*parts: DataFrame) -> DataFrame:
    """Moments of several batches together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("k").agg(F.sum("x").alias("x"))


def _moments(parts: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, centred second moments / n); d x d numbers reach the driver."""
    rows = sorted(parts.collect(), key=lambda r: r["k"])
    d = round(len(rows) ** 0.5)
    m = np.array([r["x"] for r in rows]).reshape(d, d)
    n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    return n, mean, m[:-1, :-1] / n - np.outer(mean, mean)


def lasso(g: np.ndarray, c: np.ndarray, l1: float, l2: float, start: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """The b that makes b'Gb/2 - c'b + l1 |b| + l2 b'b / 2 least, by coordinates."""
    b, grad = start.copy(), g @ start
    for _ in range(rounds):
        most = 0.0
        for j in range(len(b)):
            r = c[j] - grad[j] + g[j, j] * b[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (g[j, j] + l2 + 1e-300)
            if new != b[j]:
                grad += g[:, j] * (new - b[j])
                most, b[j] = max(most, abs(new - b[j])), new
        if most <= tol * (1 + np.abs(b).max()):
            break
    return b


def sparse_loadings(cov: np.ndarray, k: int = 5, l1: float = 0.1, l2: float = 1e-6, rounds: int = 200) -> np.ndarray:
    """(d, k) sparse unit loadings: regressions of the components on the variables, and rotations, in turn.

    ``l1`` is a share of the largest variance.  The elastic net form of sparse
    components needs the second moments alone.
    """
    w, v = np.linalg.eigh(cov)
    a = v[:, np.argsort(-w)[:k]]
    scale = max(float(w.max()), 1e-300)
    g, b = cov / scale, a.copy()
    for _ in range(rounds):
        new = np.stack([lasso(g, g @ a[:, j], l1, l2, b[:, j]) for j in range(a.shape[1])], 1)
        u, _, vt = np.linalg.svd(g @ new, full_matrices=False)
        a = u @ vt
        done = np.abs(new - b).max() < 1e-8
        b = new
        if done:
            break
    size = np.linalg.norm(b, axis=0)
    b = b / np.where(size > 0, size, 1)
    return b * np.where(b[np.abs(b).argmax(0), np.arange(b.shape[1])] < 0, -1, 1)  # the largest loading is positive


def projected(df: DataFrame, vec: str, loadings: np.ndarray, mean: np.ndarray, out: str = "sc") -> DataFrame:
    """Scores as columns: built-in expressions over the vector."""
    cols = []
    for j in range(loadings.shape[1]):
        w = F.array(*[F.lit(float(c)) for c in loadings[:, j]])
        dot = F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        cols.append((dot - float(mean @ loadings[:, j])).alias(f"{out}{j}"))
    return df.select("*", *cols)


def sparse_pca(df: DataFrame, vec: str, k: int = 5, l1: float = 0.1, parts: DataFrame | None = None) -> DataFrame:
    """Scores on sparse components (F4); with ``parts``, the moments of batches merged so far, it fits to those."""
    _, mean, cov = _moments(moments(df, vec) if parts is None else parts)
    return projected(df, vec, sparse_loadings(cov, k, l1), mean)


def member_keys(df: DataFrame, by: list[str], key: str, vec: str, params: str) -> DataFrame:
    """(by, _key): a set hash of each unit's members and the parameters.

    Sums and exclusive ors of row hashes do not depend on order and are
    combined map-side, so a unit of any size costs one row a task.
    """
    h = F.xxhash64(F.col(key), F.col(vec))
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.bit_xor(F.xxhash64(F.lit(params), F.col(key), F.col(vec))).alias("_x"))
    return sums.select(*by, F.md5(F.concat_ws("|", F.lit(params), F.col("_n").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string"))).alias("_key"))


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cached(df: DataFrame, by: list[str], key: str, vec: str, folder: str, params: str, fit: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Components of all units, and the units that had to be fitted.

    ``fit`` maps rows of some units to (by, key, comp).  What it gave is kept
    in ``folder`` under a hash of the unit's members and ``params``, and holds
    for as long as a unit has that hash: nothing is marked as changed.  Fits
    are appended by one writer at a time; equal keys hold equal components.
    """
    spark = df.sparkSession
    keys, names = member_keys(df, by, key, vec, params), {c: f"_{c}" for c in by}
    same = lambda a, b: [a[c].eqNullSafe(b[n]) for c, n in names.items()]
    old = _stored(spark, folder)
    if old is None:
        missing = keys
    else:
        held = old.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_key").alias("_held")).distinct()
        missing = keys.join(held, [*same(keys, held), keys["_key"] == held["_held"]], "left_anti")
    ask = missing.withColumnsRenamed(names).withColumnRenamed("_key", "_new")
    rows = df.join(ask.drop("_new"), same(df, ask), "left_semi")
    if missing.limit(1).count():
        new = fit(rows)
        new.join(ask, same(new, ask)).select(*by, key, "comp", F.col("_new").alias("_key")).write.mode("append").parquet(folder)
    now = keys.withColumnsRenamed(names).withColumnRenamed("_key", "_now")
    have = spark.read.parquet(folder)
    out = have.join(now, [*same(have, now), have["_key"] == now["_now"]], "left_semi").select(*by, key, "comp")
    return out, missing.select(*by)
