"""Checks and alignment of units and spikes: templates, lists, distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peak_places(waves: DataFrame, unit: str, chan: str, ti: str, v: str) -> DataFrame:
    """(unit, chan, imin, imax): first sample of the least and of the largest value of each template channel."""
    return waves.groupBy(unit, chan).agg(
        F.min(F.struct(F.col(v), F.col(ti)))[ti].alias("imin"), F.min(F.struct((-F.col(v)).alias("n"), F.col(ti)))[ti].alias("imax")
    )


def initial_alignment(waves: DataFrame, unit: str = "nid", chan: str = "chan", ti: str = "ti", v: str = "v") -> DataFrame:
    """(unit, aligni): 0 if the minima, 1 if the maxima of a template's channels scatter less over time."""
    return peak_places(waves, unit, chan, ti, v).groupBy(unit).agg(F.when(F.stddev_pop("imax") < F.stddev_pop("imin"), 1).otherwise(0).alias("aligni"))


def align_to(spikes: DataFrame, to: str) -> DataFrame:
    """Spikes aligned to their minimum or maximum.

    ``aligni`` says which of the two peaks (values V0, V1, ``dt`` apart) stands
    at ``t``; where that peak has the wrong sign, ``aligni`` and ``t`` move to
    the other, and the window with them.
    """
    at = F.when(F.col("aligni") == 0, F.col("V0")).otherwise(F.col("V1"))
    other = F.when(F.col("aligni") == 0, F.col("V1")).otherwise(F.col("V0"))
    wrong = at > other if to == "min" else at < other
    move = F.when(wrong, F.when(F.col("aligni") == 0, F.col("dt")).otherwise(-F.col("dt"))).otherwise(0)
    out = spikes.withColumn("_move", move).withColumn("aligni", F.when(wrong, 1 - F.col("aligni")).otherwise(F.col("aligni")))
    return out.withColumns({c: F.col(c) + F.col("_move") for c in ("t", "t0", "t1")}).drop("_move")


def misaligned_templates(waves: DataFrame, trigger: DataFrame, most: int = 1, unit: str = "nid", chan: str = "chan", ti: str = "ti", v: str = "v") -> DataFrame:
    """Units whose template has neither extreme on its main channel within ``most`` samples of its trigger sample (M2).

    ``trigger(unit, chan, at)`` has at most a row per unit.
    """
    places = peak_places(waves, unit, chan, ti, v).join(trigger, [unit, chan])
    off = F.least(F.abs(F.col("imin") - F.col("at")), F.abs(F.col("imax") - F.col("at")))
    return places.withColumn("off", off).filter(F.col("off") > most).select(unit, "off")


def inconsistent(spikes: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, nid) that only one of the spike table and the units' member lists holds (M9); unsorted spikes are members of none."""
    a, b = spikes.filter("nid <> 0").select("sid", "nid"), members.select("sid", "nid")
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def set_good(units: DataFrame, nids: list[int], good: bool | None = None) -> DataFrame:
    """Mark units good or not, or toggle their mark."""
    new = ~F.coalesce("good", F.lit(False)) if good is None else F.lit(good)
    return units.withColumn("good", F.when(F.col("nid").isin(nids), new).otherwise(F.coalesce("good", F.lit(False))))


def shell_volume(k: Column, width: float, dims: int) -> Column:
    """Volume of the k-th shell of a radius histogram, but for a constant."""
    return F.pow((k + 1) * width, F.lit(dims)) - F.pow(k * width, F.lit(dims))


def density_histogram(points: DataFrame, unit: str, dims: list[str], width: float = 0.25) -> DataFrame:
    """(unit, bin, n, density, normal): points by scaled distance from their unit's mean, over shell volume, and what a Gaussian has.

    Distances are in standard deviations of each dimension; densities and the
    Gaussian's values are normalised to sum to 1 over the bins that hold points.
    """
    stats = points.groupBy(unit).agg(*[f(c).alias(f"_{n}{k}") for k, c in enumerate(dims) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [F.when(F.col(f"_s{k}") > 0, (F.col(c) - F.col(f"_m{k}")) / F.col(f"_s{k}")).otherwise(0.0) for k, c in enumerate(dims)]
    radius = F.sqrt(sum((x * x for x in scaled), F.lit(0.0)))
    bins = points.join(stats, unit).withColumn("bin", F.floor(radius / width)).groupBy(unit, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(unit)
    raw = F.col("n") / shell_volume(F.col("bin"), width, len(dims))
    normal = F.exp(-0.5 * F.pow((F.col("bin") + 0.5) * width, F.lit(2.0)))
    return bins.select(unit, "bin", "n", (raw / F.sum(raw).over(w)).alias("density"), (normal / F.sum(normal).over(w)).alias("normal"))


def rotation(degrees: float, axis: str = "z") -> list[list[float]]:
    """Rotation matrix about an axis."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis]


def rotate(points: DataFrame, dims: tuple[str, str, str], degrees: float, axis: str = "z") -> DataFrame:
    """Points turned about an axis."""
    m = rotation(degrees, axis)
    return points.withColumns({d: sum((F.col(c) * m[i][k] for k, c in enumerate(dims)), F.lit(0.0)) for i, d in enumerate(dims)})
