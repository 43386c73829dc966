"""Transforms of sampled signals in long form ``(chan, ti, v)``: all built-in expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import islands, merge_intervals
from .scans import lagged, running_sum

#: Samples of a stretch of a dense grid.
GRID = 65_536


def time_slice(df: DataFrame, a_us: float, b_us: float, tres_us: float, ti: str = "ti") -> DataFrame:
    """Samples of [a, b): both ends on the nearest sample, half open (P1, P11). A filter that reaches the scan."""
    import numpy as np

    return df.filter((F.col(ti) >= int(np.rint(a_us / tres_us))) & (F.col(ti) < int(np.rint(b_us / tres_us))))


def nearest_sample(t_us: Column, tres_us: float) -> Column:
    """Time of the nearest sample."""
    return F.rint(t_us / tres_us) * tres_us


def blocks(ranges: DataFrame, size: int, excess: int = 0, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Blocks of ``size`` over ranges [t0, t1), the last clipped, with read limits widened by ``excess`` inside the range."""
    out = ranges.filter(F.col(t1) > F.col(t0)).withColumn("b0", F.explode(F.sequence(F.col(t0), F.col(t1) - 1, F.lit(size).cast("long"))))
    out = out.withColumn("b1", F.least(F.col("b0") + size, F.col(t1)))
    return out.withColumn("r0", F.greatest(F.col("b0") - excess, F.col(t0))).withColumn("r1", F.least(F.col("b1") + excess, F.col(t1)))


def car(df: DataFrame, by: list[str], v: str = "v", how: str = "median") -> DataFrame:
    """Common average reference: subtract the median or mean over the channels of each time point (T4)."""
    w = Window.partitionBy(*by)
    ref = F.median(v).over(w) if how == "median" else F.avg(v).over(w)
    return df.withColumn("car", F.col(v) - ref)


def bipolar(df: DataFrame, by: list[str], depth: list[str], v: str = "v") -> DataFrame:
    """Difference of the neighbours above and below in depth order; the ends are 0."""
    w = Window.partitionBy(*by).orderBy(*depth)
    return df.withColumn("bipolar", F.coalesce(F.lag(v).over(w) - F.lead(v).over(w), F.lit(0.0)))


def decimate(df: DataFrame, n: int, ti: str = "ti") -> DataFrame:
    """Every n-th sample, phase on the absolute index."""
    return df.filter(F.col(ti) % n == 0)


def systematic_sample(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Every (n // most + 1)-th row of a group of more than ``most`` rows."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    step = F.when(n > most, F.floor(n / most) + 1).otherwise(1)
    out = df.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_s", step)
    return out.filter(F.col("_k") % F.col("_s") == 0).drop("_k", "_s")


def saturation(df: DataFrame, v: str = "v", low: float = -32768, high: float = 32767) -> DataFrame:
    """Flag samples at the limits of the converter."""
    return df.withColumn("sat", (F.col(v) <= low) | (F.col(v) >= high))


def saturated_ranges(df: DataFrame, by: list[str], widen: int, ti: str = "ti", flag: str = "sat", block: int | None = None) -> DataFrame:
    """Runs of flagged time points, widened on both sides and merged: [lo, hi) (T12); with ``block``, scanned by blocks of samples."""
    hit = df.filter(flag).select(*by, ti).distinct()
    if block:
        hit = lagged(hit, by, [ti], [ti], block, "_b").withColumn("_p", F.col(f"_b.{ti}")).drop("_b")
    else:
        hit = hit.withColumn("_p", F.lag(ti).over(Window.partitionBy(*by).orderBy(ti)))
    runs = islands(hit, F.col("_p").isNull() | (F.col(ti) != F.col("_p") + 1), by, [ti], block=block)
    runs = runs.groupBy(*by, "island").agg((F.min(ti) - widen).alias("lo"), (F.max(ti) + 1 + widen).alias("hi")).drop("island")
    return merge_intervals(runs, by)


def ramp(df: DataFrame, by: list[str], ti: str = "ti", v: str = "v", flag: str = "bad") -> DataFrame:
    """Replace flagged runs by straight lines between the samples around them; a run at an end takes the one neighbour."""
    good = F.when(~F.col(flag), F.struct(F.col(ti).alias("t"), F.col(v).alias("v")))
    back = Window.partitionBy(*by).orderBy(ti).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(ti).rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("_a", F.last(good, True).over(back)).withColumn("_b", F.first(good, True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(ti) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    new = F.when(~F.col(flag), F.col(v)).otherwise(F.coalesce(line, F.col("_a.v"), F.col("_b.v"), F.col(v)))
    return out.withColumn("ramped", new).drop("_a", "_b")


def gap_fill(df: DataFrame, by: list[str], ti: str = "ti", v: str = "v") -> DataFrame:
    """A dense grid from each group's first to last sample, zeros where there is no data.

    The grid is made by stretches of ``GRID`` samples, dealt to all tasks, so no row holds a whole channel.
    """
    span = df.groupBy(*by).agg(F.min(ti).alias("_a"), F.max(ti).alias("_b"))
    stretch = F.explode(F.sequence(F.floor(F.col("_a") / GRID), F.floor(F.col("_b") / GRID)))
    span = span.select("*", stretch.alias("_s")).repartition(*by, "_s")
    grid = span.select(*by, F.explode(F.sequence(F.greatest("_a", F.col("_s") * GRID), F.least("_b", F.col("_s") * GRID + GRID - 1))).alias(ti))
    return grid.join(df.select(*by, ti, v), [*by, ti], "left").withColumn(v, F.coalesce(v, F.lit(0.0)))


def squeeze_gaps(df: DataFrame, by: list[str], ti: str = "ti", block: int | None = None) -> DataFrame:
    """Dense sample numbers over gaps, true times kept (U3); with ``block``, counted by blocks of samples."""
    if block:
        return running_sum(df, by, [ti], F.lit(1), block, "_n").withColumn("dense", F.col("_n") - 1).drop("_n")
    return df.withColumn("dense", F.row_number().over(Window.partitionBy(*by).orderBy(ti)) - 1)


def rolling(df: DataFrame, by: list[str], order: list[str], width: int, v: str = "v") -> DataFrame:
    """Every full window of ``width`` consecutive values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, width - 1)
    return df.withColumn("win", F.collect_list(v).over(w)).filter(F.size("win") == width)


def find_subarray(df: DataFrame, by: list[str], order: list[str], pattern: list, v: str = "v") -> DataFrame:
    """Rows where a run equal to ``pattern`` starts (P31): the following values are compared in place, none are collected."""
    w = Window.partitionBy(*by).orderBy(*order)
    names = [f"_at{k}" for k in range(len(pattern))]
    ahead = df.withColumns({n: F.lead(v, k).over(w) if k else F.col(v) for k, n in enumerate(names)})
    same = F.lit(True)
    for n, x in zip(names, pattern, strict=True):
        same &= F.coalesce(F.col(n) == F.lit(x), F.lit(False))
    return ahead.filter(same).drop(*names)


def constant_edges(df: DataFrame, by: list[str], order: list[str], v: str = "v") -> DataFrame:
    """Per group the lengths of the constant runs at its two ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.lag(v).over(w).isNull() | (F.lag(v).over(w) != F.col(v))
    runs = islands(df.withColumn("_c", change), F.col("_c"), by, order)
    size = runs.groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy(*by).agg(F.min_by("n", "island").alias("lead_n"), F.max_by("n", "island").alias("trail_n"), F.count(F.lit(1)).alias("runs"))


def shift_padded(wave: Column, n: int) -> Column:
    """Shift an array by n places, the edge value repeated into the free ones."""
    size = F.size(wave)
    if n > 0:
        return F.slice(F.concat(F.array_repeat(F.element_at(wave, 1), n), wave), F.lit(1), size)
    if n < 0:
        return F.slice(F.concat(wave, F.array_repeat(F.element_at(wave, -1), -n)), F.lit(1 - n), size)
    return wave


def normalise_amplitude(df: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Divide by the largest peak-to-peak of the group; 0 counts as 1."""
    w = Window.partitionBy(*by)
    ptp = F.max(v).over(w) - F.min(v).over(w)
    return df.withColumn("norm", F.col(v) / F.when(ptp == 0, 1.0).otherwise(ptp))


def rectified(df: DataFrame, v: str = "v") -> DataFrame:
    """Full-wave rectification, the first step of an envelope."""
    return df.withColumn("rect", F.abs(v))


def add_waves(a: DataFrame, b: DataFrame, on: list[str], sign: int = 1) -> DataFrame:
    """Sum or difference of two signals on common channels and samples."""
    return a.select(*on, F.col("v").alias("_x")).join(b.select(*on, F.col("v").alias("_y")), on).select(*on, (F.col("_x") + sign * F.col("_y")).alias("v"))


def fir(df: DataFrame, by: list[str], ti: str, taps: list[float], v: str = "v") -> DataFrame:
    """Centred FIR filter of a dense signal as a sum of shifted values, zero outside (T5)."""
    half = len(taps) // 2
    w = Window.partitionBy(*by).orderBy(ti)
    total = F.lit(0.0)
    for k, c in enumerate(taps):
        shift = k - half
        x = F.col(v) if shift == 0 else F.lag(v, shift).over(w) if shift > 0 else F.lead(v, -shift).over(w)
        total = total + F.coalesce(x, F.lit(0.0)) * float(c)
    return df.withColumn("fir", total)


def bit_shift(ad: Column, bits: int) -> Column:
    """12-bit samples to 16 bits."""
    return F.shiftleft(ad.cast("int"), bits)
