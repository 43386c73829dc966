"""Running values over long sequences without a task per key: scans over blocks.

A window over a key's whole sequence is one task, however long the sequence.
Here a key is cut into blocks of its order column; a block's summary is one
row, a window over those few rows carries it to the next block, and it enters
there as a row of its own before all others.  The window over (key, block) then
gives what the one over the key would, and the largest task holds one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocked(df: DataFrame, by: list[str], order: list[str], width: int) -> tuple[DataFrame, Window, Window]:
    """Rows with their block, the window inside a block (carried rows first), and the window over blocks."""
    rows = df.withColumn("_blk", F.floor(F.col(order[0]) / width)).withColumn("_own", F.lit(1))
    return rows, Window.partitionBy(*by, "_blk").orderBy("_own", *order), Window.partitionBy(*by).orderBy("_blk")


def _carried(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows and a row per block that brings what came before it."""
    return rows.unionByName(summaries.withColumn("_own", F.lit(0)), allowMissingColumns=True)


def lagged(df: DataFrame, by: list[str], order: list[str], values: list[str], width: int, name: str = "before") -> DataFrame:
    """``values`` of the row before, as a struct ``name``; null for the first of a key."""
    rows, inside, over = _blocked(df.withColumn("_v", F.struct(*values)), by, order, width)
    last = rows.groupBy(*by, "_blk").agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    last = last.select(*by, F.lead("_blk").over(over).alias("_blk"), "_v").filter("_blk IS NOT NULL")
    out = _carried(rows, last).withColumn(name, F.lag("_v").over(inside))
    return out.filter("_own = 1").drop("_v", "_blk", "_own")


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, width: int, name: str) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to this one; rows are told apart by ``order``."""
    rows, inside, over = _blocked(df.withColumn("_v", value), by, order, width)
    total = rows.groupBy(*by, "_blk").agg(F.sum("_v").alias("_t"))
    before = total.withColumn("_v", F.sum("_t").over(over.rowsBetween(Window.unboundedPreceding, -1))).drop("_t").filter("_v IS NOT NULL")
    out = _carried(rows, before).withColumn(name, F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter("_own = 1").drop("_v", "_blk", "_own")


def last_known(df: DataFrame, by: list[str], order: list[str], value: str, width: int, name: str) -> DataFrame:
    """The last value that is not null up to this row."""
    rows, inside, over = _blocked(df.withColumn("_v", F.col(value)), by, order, width)
    known = rows.groupBy(*by, "_blk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_v"))
    before = known.withColumn("_v", F.last("_v", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))).filter("_v IS NOT NULL")
    out = _carried(rows, before).withColumn(name, F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter("_own = 1").drop("_v", "_blk", "_own")
