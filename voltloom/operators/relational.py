"""Relational building blocks: islands, sessions, range and as-of joins, histograms, sets.

Joins on ranges get hash keys (time buckets), so no plan falls back to a
nested loop; windows are always partitioned by a key of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import lagged, last_known, running_sum


def _w(by, order):
    return Window.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, starts: Column, by: list[str], order: list[str], name: str = "island", block: int | None = None) -> DataFrame:
    """Number runs: a row where ``starts`` holds begins a new one; with ``block``, long keys are scanned by blocks of the order column."""
    if block:
        return running_sum(df, by, order, F.when(starts, 1).otherwise(0), block, name)
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def merge_intervals(df: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Union of intervals per key; touching ones merge."""
    before = _w(by, [lo, hi]).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(hi).over(before)
    runs = islands(df.withColumn("_top", top), F.col("_top").isNull() | (F.col(lo) > F.col("_top")), by, [lo, hi])
    return runs.groupBy(*by, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("island")


def sessions(df: DataFrame, by: list[str], t: str, gap: int, most: int | None = None, order: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Session number per key: a new one where the gap reaches ``gap``; then pieces of ``most`` from the session's start.

    With ``block``, keys are scanned by blocks of time, so a long one is many tasks.
    """
    order = order or [t]
    if block:
        out = lagged(df, by, order, [t], block, "_b").withColumn("_prev", F.col(f"_b.{t}")).drop("_b")
    else:
        out = df.withColumn("_prev", F.lag(t).over(_w(by, order)))
    out = islands(out, F.col("_prev").isNull() | (F.col(t) - F.col("_prev") >= gap), by, order, "session", block).drop("_prev")
    if most:
        start = F.min(t).over(Window.partitionBy(*by, "session"))
        out = out.withColumn("piece", F.floor((F.col(t) - start) / most))
    return out


def contiguous_ranges(records: DataFrame, by: list[str], t: str, length: str) -> DataFrame:
    """Time ranges without gaps: a record that does not start where the last ended starts a new range."""
    w = _w(by, [t])
    out = records.withColumn("_end", F.lag(F.col(t) + F.col(length)).over(w))
    out = islands(out, F.col("_end").isNull() | (F.col(t) != F.col("_end")), by, [t])
    return out.groupBy(*by, "island").agg(F.min(t).alias("t0"), F.max(F.col(t) + F.col(length)).alias("t1")).drop("island")


def band_join(left: DataFrame, right: DataFrame, lt: str, rt: str, low: int, high: int, by: list[tuple[str, str]] = (), order: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Pairs with ``low <= right - left < high``: an equi-join on time buckets, each left row in the buckets its range meets.

    The bucket is as wide as the range, so a left row meets two buckets.  With
    ``order``, pairs come packed (``_packed``), so files of many are a fraction in size.
    """
    width = high - low
    first, last = F.floor((F.col(lt) + low) / width), F.floor((F.col(lt) + high - 1) / width)
    a = left.withColumn("_b", F.explode(F.sequence(first, last)))
    b = right.withColumn("_b", F.floor(F.col(rt) / width))
    if order:
        return _packed(a, b, lt, rt, low, high, by, order).select(*left.columns, *right.columns)
    on = [a["_b"] == b["_b"], *[a[x] == b[y] for x, y in by]]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return a.join(b, cond & (b[rt] - a[lt] >= low) & (b[rt] - a[lt] < high)).drop(a["_b"]).drop(b["_b"])


#: Right rows that come again and again, left row by left row: few enough for the window of a fast codec. Rows of both sides in a task: their ids fit a dictionary.
CHUNK, TASK_ROWS = 128, 1 << 15


def _packed(a: DataFrame, b: DataFrame, lt: str, rt: str, low: int, high: int, by: list[tuple[str, str]], order: tuple[list[str], list[str]]) -> DataFrame:
    """Pairs of rows that share ``_b``: a chunk of right rows in their order, for it every left row in its order, for that the rows of the chunk.

    Left columns are then runs and right columns repeat within a few hundred
    values, however many rows a bucket holds.  The rows are counted first: so
    many tasks that dictionaries of a column stay small.
    """
    spark = a.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-(a.count() + b.count()) // TASK_ROWS))
    keys = ["_b", *[y for _, y in by]]
    rest = [c for c in b.columns if c not in {*order[1], "_b"}]
    b = b.filter(F.col("_b").isNotNull()).repartition(parts, "_b")
    b = b.withColumn("_c", F.floor((F.row_number().over(_w(keys, order[1])) - 1) / CHUNK))
    rows = F.sort_array(F.collect_list(F.struct(*order[1], *rest))).alias("_rows")
    b = b.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_c").agg(F.min(rt).alias("_lo"), F.max(rt).alias("_hi"), rows)
    a = a.repartition(parts, "_b")
    # a sort right below a join is left out of the plan; row numbers that are read keep it
    keep = lambda x, *cols: x.sortWithinPartitions(*cols).withColumn("_n", F.monotonically_increasing_id()).filter("_n >= 0").drop("_n")
    cond = (F.col("_k0") == F.col("_b")) & (F.col("_hi") - F.col(lt) >= low) & (F.col("_lo") - F.col(lt) < high)
    for i, (x, _) in enumerate(by, 1):
        cond &= F.col(f"_k{i}") == F.col(x)
    out = keep(b, "_k0", "_c").join(keep(a, "_b", *order[0]).hint("merge"), cond)
    out = out.select(*[c for c in a.columns if c != "_b"], F.inline("_rows"))
    return out.filter((F.col(rt) - F.col(lt) >= low) & (F.col(rt) - F.col(lt) < high))


def overlap_join(left: DataFrame, right: DataFrame, width: int, l0: str, l1: str, r0: str, r1: str) -> DataFrame:
    """Pairs of half-open ranges that overlap, once each, by buckets of ``width``."""
    ends = lambda x, y: F.sequence(F.floor(F.col(x) / width), F.floor((F.col(y) - 1) / width))
    a = left.withColumn("_b", F.explode(ends(l0, l1))).withColumn("_lb", F.floor(F.col(l0) / width))
    b = right.withColumn("_b", F.explode(ends(r0, r1))).withColumn("_rb", F.floor(F.col(r0) / width))
    out = a.join(b, "_b").filter((F.col(l0) < F.col(r1)) & (F.col(r0) < F.col(l1)))
    return out.filter(F.col("_b") == F.greatest("_lb", "_rb")).drop("_b", "_lb", "_rb")


def asof(left: DataFrame, right: DataFrame, lt: str, rt: str, values: list[str], by: list[str], block: int | None = None) -> DataFrame:
    """For every left row the values of the last right row not after it, per key (J13): one union and one window, no pair is made.

    With ``block``, keys are scanned by blocks of time, so a hot one is many tasks.
    """
    l_cols = left.columns
    a = left.withColumn("_t", F.col(lt)).withColumn("_side", F.lit(1))
    b = right.select(*by, F.col(rt).alias("_t"), F.struct(rt, *values).alias("_v")).withColumn("_side", F.lit(0))
    both = a.withColumn("_v", F.lit(None).cast(b.schema["_v"].dataType)).unionByName(b, allowMissingColumns=True)
    if block:
        out = last_known(both.withColumnRenamed("_v", "_r"), by, ["_t", "_side"], "_r", block, "_k").filter("_side = 1").withColumnRenamed("_k", "_v")
        return out.select(*l_cols, *[F.col(f"_v.{c}").alias(c) for c in [rt, *values]])
    w = _w(by, ["_t", "_side"]).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*l_cols, *[F.col(f"_v.{c}").alias(c) for c in [rt, *values]])


def argmatch(keys: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows of a lookup with unique keys for every key; a missing key keeps nulls and found = false."""
    return keys.join(lookup.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def duplicated_keys(lookup: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique, with their counts."""
    return lookup.groupBy(key).count().filter("count > 1")


def histogram(df: DataFrame, value: Column, by: list[str], lo: float, hi: float, bins: int, name: str = "bin") -> DataFrame:
    """Counts in equal bins of [lo, hi], right edge inclusive."""
    width = (hi - lo) / bins
    b = F.least(F.floor((value - lo) / width), F.lit(bins - 1))
    return df.filter((value >= lo) & (value <= hi)).groupBy(*by, b.cast("int").alias(name)).agg(F.count(F.lit(1)).alias("n"))


def sqrt_bins(n: int, least: int = 2, most: int = 1 << 30) -> int:
    """Number of bins (or edges) from a count: rint(sqrt n) within limits."""
    import numpy as np

    return int(np.clip(int(np.rint(np.sqrt(n))), least, most))


def common_members(df: DataFrame, member: str, group: str) -> DataFrame:
    """Members that occur in every group."""
    total = df.select(group).distinct().agg(F.count(F.lit(1)).alias("_groups"))
    seen = df.select(member, group).distinct().groupBy(member).agg(F.count(F.lit(1)).alias("_n"))
    return seen.join(F.broadcast(total), F.col("_n") == F.col("_groups")).select(member)


def descents(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is below the one before."""
    return df.withColumn("_p", F.lag(value).over(_w(by, order))).filter(F.col("_p") > F.col(value)).drop("_p")


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key in an explicit order."""
    return df.withColumn(name, F.row_number().over(_w(by, order))).filter(F.col(name) <= k)
