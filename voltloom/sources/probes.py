"""Probe geometry and adapters as small DataFrames, built from rules or read from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROBE = "probe string, chan int, x double, y double"


def columns(name: str, per_column: list[int], pitch: float, x_step: float, offsets: list[float] | None = None, first: int = 0) -> list[tuple]:
    """Sites in columns from the tip upwards; ``offsets`` shift columns in depth."""
    rows, chan = [], first
    for c, n in enumerate(per_column):
        for k in range(n):
            rows.append((name, chan, c * x_step, k * pitch + (offsets[c] if offsets else 0.0)))
            chan += 1
    return rows


def linear(name: str, n: int, pitch: float, first: int = 0) -> list[tuple]:
    return columns(name, [n], pitch, 0.0, None, first)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PROBE)


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PROBE)


def summary(probes: DataFrame) -> DataFrame:
    """Sites, distinct columns and rows, depth separation (null if not uniform, 0 for one row), first channel (G1)."""
    w = Window.partitionBy("probe").orderBy("y")
    step = probes.select("probe", "y").distinct().withColumn("_d", F.lead("y").over(w) - F.col("y"))
    sep = step.groupBy("probe").agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"), F.count(F.lit(1)).alias("nrows"))
    out = probes.groupBy("probe").agg(F.count(F.lit(1)).alias("nchans"), F.count_distinct("x").alias("ncols"), F.min("chan").alias("chan0"))
    return out.join(sep, "probe").select("probe", "nchans", "ncols", "nrows", "chan0", F.when(F.col("_a").isNull(), 0.0).when(F.col("_a") == F.col("_b"), F.col("_a")).alias("ysep"))


def shanks(probes: DataFrame, shifts: list[tuple[float, float]]) -> DataFrame:
    """A probe repeated at shank positions; channel numbers continue."""
    spark = probes.sparkSession
    s = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(shifts)], "shank int, dx double, dy double")
    n = probes.groupBy("probe").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    out = probes.join(n, "probe").join(F.broadcast(s))
    return out.select("probe", (F.col("chan") + F.col("shank") * F.col("_n")).alias("chan"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))


def match_sites(probes: DataFrame, sites: DataFrame) -> DataFrame:
    """Names of probes whose sites are exactly those given."""
    key = lambda df, by: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("chan", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_k"))
    return key(probes.select("probe", F.col("chan").cast("int").alias("chan"), "x", "y"), ["probe"]).join(key(sites.select(F.col("chan").cast("int").alias("chan"), "x", "y"), []), "_k").select("probe")


def order_by_axes(probes: DataFrame, axes: list[str], ascending: list[bool] | None = None) -> DataFrame:
    """Channels in spatial order; the last axis is the primary key (O2, O3)."""
    up = ascending or [True] * len(axes)
    cols = [F.col(a).asc() if u else F.col(a).desc() for a, u in zip(axes, up, strict=True)][::-1]
    return probes.withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(*cols, "chan")) - 1)


def adapt(probes: DataFrame, adapter: DataFrame) -> DataFrame:
    """Converter channel of each probe channel through an adapter."""
    return probes.join(adapter.select(F.col("probe_chan").alias("chan"), "ad_chan"), "chan", "left")
