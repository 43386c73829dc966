"""Connected components of a graph by alternating large-star and small-star steps.

Each step is one aggregate and one join over the edges; a hub with very many
edges is pre-aggregated map-side and its join partition can be split at run
time.  Edges are written to the shared folder after every round, so lineage
stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the component's least node."""
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    e, mark = _round(e)
    start = e
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour is tied to the least one
        e = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        # every smaller neighbour is tied to the least one
        joined = e.join(least, "u")
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, old = mark, start
        e, mark = _round(e)
        common.forget(old)
        start = e
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select("v", "v").distinct().toDF("node", "root"))


def _round(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = common.materialize(e, "edges")
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return e, tuple(r)
