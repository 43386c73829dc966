"""Noise, thresholds, peak sharpness and neighbourhoods, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import islands
from .scans import lagged


def noise_median(v: str = "v") -> Column:
    """Robust noise level: lower median of |v| / 0.6745 (A1)."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY abs({v})) / 0.6745D")


def noise(df: DataFrame, by: list[str], v: str = "v", how: str = "median") -> DataFrame:
    """Noise per key (A1, A2)."""
    level = noise_median(v) if how == "median" else F.stddev_pop(v)
    return df.groupBy(*by).agg(level.alias("noise"))


def thresholds(df: DataFrame, by: list[str], v: str = "v", mult: float = 4.5, fixed: float = 40.0, pp_mult: float = 1.5, how: str = "median") -> DataFrame:
    """Dynamic thresholds per key: rounded noise multiple, never below the fixed one, and the peak-to-peak threshold."""
    out = noise(df, by, v, how).withColumn("thresh", F.greatest(F.rint(F.col("noise") * mult), F.lit(fixed)))
    return out.withColumn("ppthresh", F.rint(F.col("thresh") * pp_mult))


def sharpness(df: DataFrame, by: list[str], ti: str = "ti", v: str = "v", block: int | None = None) -> DataFrame:
    """Peaks and their sharpness.

    A segment lies between sign changes of ``v > 0``; only segments closed on
    both sides count. Its peak is the first largest |v|, worth v * |v| / samples.
    With ``block``, channels are scanned by blocks of samples, so one channel is many tasks.
    """
    up = F.col(v) > 0
    out = df.withColumn("_up", up)
    if block:
        out = lagged(out, by, [ti], ["_up"], block, "_b").withColumn("_was", F.col("_b._up")).drop("_b")
    else:
        out = out.withColumn("_was", F.lag(up).over(Window.partitionBy(*by).orderBy(ti)))
    out = islands(out, F.col("_was").isNull() | (F.col("_was") != F.col("_up")), by, [ti], "_seg", block)
    peak = F.min_by(F.struct(F.col(ti).alias("ti"), F.col(v).alias("v")), F.struct(-F.abs(v), F.col(ti)))
    seg = out.groupBy(*by, "_seg").agg(peak.alias("_p"), F.count(F.lit(1)).alias("npoints"))
    if block:
        seg = seg.join(out.groupBy(*by).agg(F.max("_seg").alias("_last")), by)
    else:
        seg = seg.withColumn("_last", F.max("_seg").over(Window.partitionBy(*by)))
    seg = seg.filter((F.col("_seg") > 1) & (F.col("_seg") < F.col("_last")))
    return seg.select(*by, F.col("_p.ti").alias("ti"), F.col("_p.v").alias("v"), (F.col("_p.v") * F.abs("_p.v") / F.col("npoints")).alias("sharp"))


def threshold_peaks(peaks: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """Peaks of |v| at or above their key's threshold (W2). Limits hold a row per key; the optimizer picks the join."""
    return peaks.join(limits.select(*by, "thresh"), by).filter((F.col("sharp") != 0) & (F.abs("v") >= F.col("thresh")))


def distances(sites: DataFrame, chan: str = "chan", x: str = "x", y: str = "y") -> DataFrame:
    """Distance of every two sites of a probe (J2, J3); a probe has at most 256 sites."""
    keys = [c for c in sites.columns if c not in (chan, x, y)]
    a = sites.select(*keys, F.col(chan).alias("a"), F.col(x).alias("_ax"), F.col(y).alias("_ay"))
    b = sites.select(*keys, F.col(chan).alias("b"), F.col(x).alias("_bx"), F.col(y).alias("_by"))
    pairs = a.join(b, keys) if keys else a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return pairs.select(*keys, "a", "b", F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), 2) + F.pow(F.col("_ay") - F.col("_by"), 2)).alias("d"))


def neighbourhoods(sites: DataFrame, radius: float, chan: str = "chan", x: str = "x", y: str = "y") -> DataFrame:
    """Channels within a radius of each channel, itself included."""
    d = distances(sites, chan, x, y)
    keys = [c for c in d.columns if c not in ("a", "b", "d")]
    return d.filter(F.col("d") <= radius).groupBy(*keys, F.col("a").alias("chan")).agg(F.sort_array(F.collect_list("b")).alias("nbhd"))


def spatial_mean(df: DataFrame, by: list[str], w: str = "w", x: str = "x", y: str = "y") -> DataFrame:
    """Centroid weighted by |w|; plain mean where all weights are 0."""
    total = F.sum(F.abs(w))
    mean = lambda c: F.when(total == 0, F.avg(c)).otherwise(F.try_divide(F.sum(F.abs(w) * F.col(c)), total))
    return df.groupBy(*by).agg(mean(x).alias("x0"), mean(y).alias("y0"))


def local_maxima(df: DataFrame, by: list[str], order: list[str], v: str = "v") -> DataFrame:
    """Strict local maxima."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_a", F.lag(v).over(w)).withColumn("_b", F.lead(v).over(w))
    return out.filter((F.col("_a") < F.col(v)) & (F.col("_b") < F.col(v))).drop("_a", "_b")


def number_spikes(spikes: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Ids in time order within each recording (O1)."""
    return spikes.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
