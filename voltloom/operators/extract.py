"""Features of spike shape: temporal and spatial fits in batches, wavelet coefficients and the least normal of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batch_fits

TEMPORAL = "sid long, V0 double, V1 double, s0 double, s1 double, Voff double, rmse double, settled boolean"


def _record(ddl: str, *cols) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[c.split()[0] for c in ddl.split(", ")])


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, and where it has values; nulls inside count as missing."""
    n = np.diff(lists.offsets.to_numpy())
    mask = np.arange(max(n.max(initial=0), 1)) < n[:, None]
    x = np.full(mask.shape, np.nan)
    x[mask] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.nan_to_num(x), ~np.isnan(x)


def temporal_fits(spikes: DataFrame, tres_us: float, width_us: float = 60.0) -> DataFrame:
    """Two Gaussians at the spike's peaks, fitted to the wave of its largest channel.

    ``spikes(sid, v array<double>, peak0, peak1, V0, V1)``: peaks are sample
    numbers in the wave.  Widths start at ``width_us`` and come out positive, in
    us; rmse is over the wave's samples.  A wave without samples, or with a
    peak or start that is null, is not settled and keeps its start.
    """
    rows = spikes.select("sid", F.coalesce(F.col("v").cast("array<double>"), F.array().cast("array<double>")), *[F.col(c).cast("double") for c in ("peak0", "peak1", "V0", "V1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, mask = _padded(b.column(1))
            peak0, peak1, v0, v1 = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
            start = np.stack([v0, v1, np.full(len(v0), width_us), np.full(len(v0), width_us), np.zeros(len(v0))], 1)
            known = mask.any(1)
            start[~known, 0] = np.nan
            p, cost, settled = batch_fits.levenberg(batch_fits.two_gaussians(np.arange(v.shape[1]) * tres_us, peak0 * tres_us, peak1 * tres_us), start, v, mask)
            p[:, 2:4] = np.abs(p[:, 2:4])
            rmse = np.sqrt(cost / np.maximum(mask.sum(1), 1))
            cols = [pa.array(x, from_pandas=True) for x in (*np.where(known[:, None], p, np.nan).T, np.where(settled, rmse, np.nan))]
            yield _record(TEMPORAL, b.column(0).cast(pa.int64()), *cols, settled)

    return rows.mapInArrow(run, TEMPORAL)


SPATIAL = "sid long, x0 double, y0 double, sx double, sy double, rmse double, settled boolean"


def spatial_fits(spikes: DataFrame, probe: dict[int, tuple[float, float]], kind: str = "x0y0s_sym", width_um: float = 60.0) -> DataFrame:
    """A Gaussian over a spike's channels, by one of the fits ``batch_fits.SPATIAL``.

    ``spikes(sid, chans array<int>, w array<double>)`` and, where given, starts
    x0, y0, sx and sy.  The height is the largest weight, the centre starts at
    the weights' mean and the widths at ``width_um``.  A spike of no channels
    is not settled.
    """
    given = {c: (F.col(c) if c in spikes.columns else F.lit(None)).cast("double").alias(f"_{c}") for c in ("x0", "y0", "sx", "sy")}
    w = F.coalesce(F.col("w").cast("array<double>"), F.array().cast("array<double>"))
    rows = spikes.select("sid", F.slice(F.coalesce("chans", F.array().cast("array<int>")), F.lit(1), F.size(w)), w, *given.values())
    sites = np.array([probe[c] for c in sorted(probe)], float)
    names = np.array(sorted(probe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, mask = _padded(b.column(2))
            chan, there = _padded(b.column(1).cast(pa.list_(pa.float64())))
            if chan.shape != v.shape or not np.isin(chan[there].astype(int), names).all():
                raise ValueError("channels and weights of a spike differ in number, or a channel is not of the probe")
            at = np.searchsorted(names, chan.astype(int)).clip(max=len(names) - 1)
            x, y, v = sites[at, 0], sites[at, 1], np.abs(v)
            total = (v * mask).sum(1)
            mean = [np.where(total > 0, (s * v * mask).sum(1) / np.where(total > 0, total, 1), (s * mask).sum(1) / np.maximum(mask.sum(1), 1)) for s in (x, y)]
            start = np.stack([*mean, np.full(len(v), width_um), np.full(len(v), width_um)], 1)
            asked = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(3, 7)], 1)
            start = np.where(np.isnan(asked), start, asked)
            start[~mask.any(1)] = np.nan
            p, cost, settled = batch_fits.fit_spatial(kind, start, (v * mask).max(1), x, y, v, mask)
            cols = [pa.array(c, from_pandas=True) for c in (*p.T, np.where(settled, np.sqrt(cost / np.maximum(mask.sum(1), 1)), np.nan))]
            yield _record(SPATIAL, b.column(0).cast(pa.int64()), *cols, settled)

    return rows.mapInArrow(run, SPATIAL)


def haar(wave: Column, nt: int) -> Column:
    """Haar coefficients of a wave of ``nt`` samples, coarsest first; an odd length repeats its last value.

    A level is bound to a lambda's variable, so each is computed once.
    """

    def level(a: Column, details: Column, n: int) -> Column:
        if n < 2:
            return F.concat(a, details)
        half = (n + 1) // 2
        at = lambda k: F.element_at(a, F.least(k, F.lit(n)))
        pairs = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(half)), lambda k: (at(k * 2 - 1) + sign * at(k * 2)) * (0.5**0.5))
        bound = F.array(F.struct(pairs(1).alias("a"), F.concat(pairs(-1), details).alias("d")))
        return F.element_at(F.transform(bound, lambda x: level(x["a"], x["d"], half)), 1)

    return level(wave, F.array().cast("array<double>"), nt)


def haar_size(nt: int) -> int:
    """How many coefficients ``haar`` gives."""
    sizes = []
    while nt > 1:
        nt = (nt + 1) // 2
        sizes.append(nt)
    return sum(sizes) + (sizes[-1] if sizes else nt)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, within 7.5e-8 (a rational approximation with five terms)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * (1 / (2 * np.pi) ** 0.5) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (group, i, n, F): a row per run of a group in this partition, with the differences from its local ranks."""
    part = TaskContext.get().partitionId()
    held: list = []  # group, i, n, rows so far, most above, most below

    def row():
        g, i, n, count, above, below = held
        return pa.RecordBatch.from_pylist([{"g": g, "i": i, "part": part, "rows": count, "n": n, "above": above, "below": below}], schema=pa.schema([("g", pa.string()), ("i", pa.int32()), ("part", pa.int32()), ("rows", pa.int64()), ("n", pa.int64()), ("above", pa.float64()), ("below", pa.float64())]))

    for b in batches:
        g, i = b.column(0).to_pylist(), b.column(1).to_numpy()
        n, f = b.column(2).to_numpy(), b.column(3).to_numpy()
        names = np.array(g, object)
        cuts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]) | (i[1:] != i[:-1])) + 1, [len(i)]])
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == z:
                continue
            if not held or held[0] != g[a] or held[1] != i[a]:
                if held:
                    yield row()
                held[:] = [g[a], int(i[a]), int(n[a]), 0, -np.inf, -np.inf]
            rank = held[3] + np.arange(1, z - a + 1)
            held[4] = max(held[4], float((rank / n[a] - f[a:z]).max()))
            held[5] = max(held[5], float((f[a:z] - (rank - 1) / n[a]).max()))
            held[3] += z - a
    if held:
        yield row()


def normality(rows: DataFrame, group: str, values: str, broadcast_rows: int = 200_000) -> DataFrame:
    """(group, i, n, ks): Kolmogorov-Smirnov distance of every element of the arrays ``values`` from the standard normal.

    Values are range-sorted by group, element and value, so a large group lies
    in many tasks.  A task ranks its runs from one and keeps the largest
    differences above and below; what ranks lack from the partitions before is
    the same for all rows of a run and is added to its two numbers afterwards,
    so a row per run is all that meets.  Null and NaN values take no part; a
    null group is a group.
    """
    spark = rows.sparkSession
    long = rows.select(F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("g"), F.posexplode(F.col(values).cast("array<double>")).alias("i", "x")).filter("x IS NOT NULL AND NOT isnan(x)")
    sizes = long.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= broadcast_rows else sizes
    order = ["g", "i", "x"]
    placed = long.join(sizes, ["g", "i"]).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    runs = placed.select("g", "i", "n", normal_cdf(F.col("x")).alias("f")).mapInArrow(_runs, "g string, i int, part int, rows long, n long, above double, below double")
    before = (F.sum("rows").over(Window.partitionBy("g", "i").orderBy("part")) - F.col("rows")) / F.col("n")
    ks = runs.withColumn("d", F.greatest(F.col("above") + before, F.col("below") - before)).groupBy("g", "i").agg(F.first("n").alias("n"), F.max("d").alias("ks"))
    return ks.select(F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).cast(rows.schema[group].dataType).alias(group), "i", "n", "ks")


def least_normal(ks: DataFrame, group: str | None = None, k: int = 5) -> DataFrame:
    """The ``k`` elements furthest from normal: of each group, or by the mean over groups."""
    if group is None:
        mean = ks.groupBy("i").agg(F.avg("ks").alias("ks"))
        return mean.orderBy(F.desc("ks"), "i").limit(k)
    w = Window.partitionBy(group).orderBy(F.desc("ks"), "i")
    return ks.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
