"""Units: templates, positions, matching, splits, and a versioned assignment log."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def templates(waves: DataFrame, unit: str = "nid", chan: str = "chan", ti: str = "ti", v: str = "v", spike: str = "sid") -> DataFrame:
    """Mean and population deviation per (unit, channel, sample), of channels at least half of the unit's spikes have."""
    size = waves.groupBy(unit).agg(F.count_distinct(spike).alias("_size"))
    out = waves.groupBy(unit, chan, ti).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(F.lit(1)).alias("n"))
    return out.join(size, unit).filter(F.col("n") * 2 >= F.col("_size")).drop("_size")


def max_channel(temps: DataFrame, unit: str = "nid", chan: str = "chan") -> DataFrame:
    """The channel with the largest peak-to-peak mean; the first of equals."""
    ptp = temps.groupBy(unit, chan).agg((F.max("mean") - F.min("mean")).alias("ptp"))
    return ptp.groupBy(unit).agg(F.min_by(F.struct(chan, "ptp"), F.struct(-F.col("ptp"), F.col(chan))).alias("_m")).select(unit, f"_m.{chan}", "_m.ptp")


def positions(points: DataFrame, unit: str, dims: list[str]) -> DataFrame:
    """Median per dimension, and the median in global standard deviations from the global mean."""
    stats = points.agg(*[F.avg(d).alias(f"_m_{d}") for d in dims], *[F.stddev_pop(d).alias(f"_s_{d}") for d in dims])
    pos = points.groupBy(unit).agg(*[F.median(d).alias(d) for d in dims])
    out = pos.join(F.broadcast(stats))  # one row of statistics
    norm = [((F.col(d) - F.col(f"_m_{d}")) / F.when(F.col(f"_s_{d}") == 0, 1.0).otherwise(F.col(f"_s_{d}"))).alias(f"norm_{d}") for d in dims]
    return out.select(unit, *dims, *norm)


def parameter_matrix(points: DataFrame, key: str, dims: list[str], shared: dict[str, str] | None = None) -> DataFrame:
    """Zero-mean, unit-deviation columns; ``shared`` scales a column by another's deviation, as for x and y (F1)."""
    shared = shared or {}
    stats = points.agg(*[F.avg(d).alias(f"_m_{d}") for d in dims], *[F.stddev_pop(d).alias(f"_s_{d}") for d in dims])
    out = points.join(F.broadcast(stats))
    cols = []
    for d in dims:
        s = F.col(f"_s_{shared.get(d, d)}")
        cols.append(((F.col(d) - F.col(f"_m_{d}")) / F.when(s == 0, 1.0).otherwise(s)).alias(d))
    return out.select(key, *cols)


def rms_to_templates(waves: DataFrame, temps: DataFrame, unit: str = "nid", spike: str = "sid", on: tuple[str, ...] = ("chan", "ti"), v: str = "v") -> DataFrame:
    """Root mean square difference of every wave to every template on their common samples.

    Templates are few per channel; waves join them on channel and sample.
    """
    pairs = waves.select(spike, *on, F.col(v).alias("_v")).join(temps.select(unit, *on, "mean"), list(on))
    return pairs.groupBy(spike, unit).agg(F.sqrt(F.avg(F.pow(F.col("_v") - F.col("mean"), 2))).alias("rms"), F.count(F.lit(1)).alias("n"))


def best_match(errors: DataFrame, spike: str = "sid", unit: str = "nid", limit: float | None = None) -> DataFrame:
    """The unit of least error for each spike, ties to the smaller id (M7)."""
    out = errors if limit is None else errors.filter(F.col("rms") <= limit)
    return out.groupBy(spike).agg(F.min(F.struct("rms", unit)).alias("_b")).select(spike, f"_b.{unit}", "_b.rms")


def match_units(waves: DataFrame, temps: DataFrame, unit: str = "nid", spike: str = "sid", on: tuple[str, ...] = ("chan", "ti"), v: str = "v", limit: float | None = None, most_cells: int = 5_000_000) -> DataFrame:
    """(spike, unit, rms): ``best_match`` of ``rms_to_templates`` without a row for every spike, unit and sample (M7).

    Each spike's samples meet once, as one row.  Templates are sent to all
    tasks after their cells have been counted; there, sums of squares over the
    common samples of a batch of spikes and all units are three matrix
    products, and the least of a spike is all that leaves.  Where templates
    have more cells than ``most_cells``, waves and templates are joined instead.
    """
    import numpy as np
    import pandas as pd

    held = temps.select(unit, *on, F.col("mean").cast("double").alias("mean")).dropna()
    if held.count() > most_cells:
        return best_match(rms_to_templates(waves, temps, unit, spike, on, v), spike, unit, limit)
    table = held.toPandas()
    names = np.array(sorted(set(table[unit].tolist())), object)
    places = {k: i for i, k in enumerate(dict.fromkeys(zip(*[table[c].tolist() for c in on], strict=True)))}
    row, col = np.searchsorted(names, np.array(table[unit].tolist(), object)) if len(names) else np.zeros(0, int), np.array([places[k] for k in zip(*[table[c].tolist() for c in on], strict=True)], int)
    mean, there = np.zeros((2, len(names), max(1, len(places))))
    mean[row, col], there[row, col] = table["mean"], 1.0
    parts = [there.T, (mean * there).T, (mean**2 * there).T]
    grouped = waves.filter(F.col(v).isNotNull()).groupBy(spike).agg(F.collect_list(F.struct(*on, F.col(v).cast("double").alias("_v"))).alias("_w"))
    kinds = dict(waves.dtypes) | dict(temps.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                some = pdf.iloc[a : a + 256]
                x, mask = np.zeros((2, len(some), max(1, len(places))))
                for i, w in enumerate(some["_w"]):
                    for s in w:
                        k = places.get(tuple(s[c] for c in on))
                        if k is not None:
                            x[i, k], mask[i, k] = s["_v"], 1.0
                n = mask @ parts[0]
                square = np.maximum((x**2) @ parts[0] - 2 * (x @ parts[1]) + mask @ parts[2], 0)
                rms = np.where(n > 0, np.sqrt(square / np.maximum(n, 1)), np.inf)
                best = rms.argmin(1) if len(names) else np.zeros(0, int)
                keep = np.isfinite(rms[np.arange(len(best)), best]) if len(best) else np.zeros(0, bool)
                chosen = names[best][keep].tolist() if len(best) else []
                values = rms[np.arange(len(best)), best][keep] if len(best) else []
                yield pd.DataFrame({spike: pd.Series(np.array(some[spike].tolist(), object)[: len(best)][keep], dtype=object), unit: pd.Series(chosen, dtype=object), "rms": values})

    out = grouped.mapInPandas(run, f"{spike} {kinds[spike]}, {unit} {kinds[unit]}, rms double")
    return out if limit is None else out.filter(F.col("rms") <= limit)


def similar_units(temps: DataFrame, unit: str = "nid", on: tuple[str, ...] = ("chan", "ti")) -> DataFrame:
    """Units ranked by rms difference of templates to each unit."""
    a = temps.select(F.col(unit).alias("a"), *on, F.col("mean").alias("_x"))
    b = temps.select(F.col(unit).alias("b"), *on, F.col("mean").alias("_y"))
    d = a.join(b, list(on)).filter("a <> b").groupBy("a", "b").agg(F.sqrt(F.avg(F.pow(F.col("_x") - F.col("_y"), 2))).alias("rms"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("rms", "b")))


# ---------------------------------------------------------------- splits


def split_by(df: DataFrame, by: list[str], order: list, name: str = "part") -> DataFrame:
    """Number the distinct values of an expression within each key: by max channel, or by channel combination.

    The distinct values are numbered, then joined back, so no window holds all
    rows of a unit.
    """
    keyed = df.withColumn("_v", F.struct(*order))
    values = keyed.select(*by, "_v").distinct()
    values = values.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("_v")))
    return keyed.join(values, [*by, "_v"]).drop("_v")


def density_split(points: DataFrame, unit: str, a, b, dims: list[str], bins: int = 20) -> DataFrame:
    """Split the points of two units at the sparsest bin between their medians, on the line through them."""
    m = points.filter(F.col(unit).isin(a, b)).groupBy(unit).agg(*[F.median(d).alias(d) for d in dims])
    both = m.agg(*[F.max(F.when(F.col(unit) == a, F.col(d))).alias(f"_a_{d}") for d in dims], *[F.max(F.when(F.col(unit) == b, F.col(d))).alias(f"_b_{d}") for d in dims])
    rows = points.filter(F.col(unit).isin(a, b)).join(F.broadcast(both))
    length2 = sum((F.pow(F.col(f"_b_{d}") - F.col(f"_a_{d}"), 2) for d in dims), F.lit(0.0))
    along = sum(((F.col(d) - F.col(f"_a_{d}")) * (F.col(f"_b_{d}") - F.col(f"_a_{d}")) for d in dims), F.lit(0.0))
    rows = rows.withColumn("pos", F.when(length2 > 0, along / length2).otherwise(0.0))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    inside = rows.filter((F.col("pos") >= 0) & (F.col("pos") < 1)).groupBy(F.floor(F.col("pos") * bins).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sparse = grid.join(inside, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n")).agg(F.min(F.struct("n", "bin")).alias("_s"))
    cut = sparse.select(((F.col("_s.bin") + 0.5) / bins).alias("cut"))
    return rows.join(F.broadcast(cut)).withColumn("side", F.when(F.col("pos") < F.col("cut"), 1).otherwise(2)).drop(*[f"_{s}_{d}" for s in "ab" for d in dims])


def random_split(df: DataFrame, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """Two halves by a seeded hash order."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("half", F.ntile(2).over(w))


def beyond_radius(points: DataFrame, unit: str, dims: list[str], stds: float = 4.0) -> DataFrame:
    """Points further from their unit's median than ``stds`` root-mean-square radii (C11)."""
    med = points.groupBy(unit).agg(*[F.median(d).alias(f"_m_{d}") for d in dims])
    r2 = sum((F.pow(F.col(d) - F.col(f"_m_{d}"), 2) for d in dims), F.lit(0.0))
    rows = points.join(med, unit).withColumn("r", F.sqrt(r2))
    scale = rows.groupBy(unit).agg(F.sqrt(F.avg(F.pow("r", 2))).alias("_scale"))
    return rows.join(scale, unit).filter(F.col("r") > stds * F.col("_scale")).drop("_scale", *[f"_m_{d}" for d in dims])


# ---------------------------------------------------------------- assignments and their log

LOG = "version long, sid long, old_nid long, new_nid long, op string"


def change(current: DataFrame, new: DataFrame, version: int, op: str) -> DataFrame:
    """Log rows for spikes whose unit changes: ``new(sid, nid)`` against ``current(sid, nid)``."""
    n = new.select("sid", F.col("nid").alias("new_nid"))
    out = current.select("sid", F.col("nid").alias("old_nid")).join(n, "sid").filter("old_nid <> new_nid")
    return out.select(F.lit(version).cast("long").alias("version"), "sid", "old_nid", "new_nid", F.lit(op).alias("op"))


def at_version(initial: DataFrame, log: DataFrame, version: int) -> DataFrame:
    """Assignments after applying the log up to a version; an older version is an undo, a newer one a redo (C17)."""
    last = log.filter(F.col("version") <= version).groupBy("sid").agg(F.max_by("new_nid", "version").alias("_n"))
    return initial.join(last, "sid", "left").select("sid", F.coalesce("_n", "nid").alias("nid"))


def merge_units(current: DataFrame, units: list[int]) -> DataFrame:
    """(sid, nid) of the members of ``units`` after a merge into the largest single unit, or a new one if there is none."""
    members = current.filter(F.col("nid").isin(units))
    size = members.filter("nid > 0").groupBy("nid").count()
    into = size.agg(F.min(F.struct(-F.col("count"), F.col("nid"))).getField("nid").alias("_into"))
    fresh = current.agg(F.greatest(F.max("nid") + 1, F.lit(1)).alias("_fresh"))
    return members.join(F.broadcast(into)).join(F.broadcast(fresh)).select("sid", F.coalesce("_into", "_fresh").alias("nid"))


def delete_units(current: DataFrame, units: list[int]) -> DataFrame:
    """Members of units become unsorted."""
    return current.filter(F.col("nid").isin(units)).select("sid", F.lit(0).cast("long").alias("nid"))


def next_ids(current: DataFrame) -> DataFrame:
    """The next single-unit and multiunit ids."""
    return current.agg(F.greatest(F.max("nid") + 1, F.lit(1)).alias("single"), F.least(F.min("nid") - 1, F.lit(-1)).alias("multi"))


def label_multiunit(current: DataFrame, units: list[int]) -> DataFrame:
    """Members of each unit get the next negative ids, in order of unit (C14)."""
    low = current.agg(F.least(F.min("nid") - 1, F.lit(-1)).alias("_low"))
    some = current.filter(F.col("nid").isin(units))
    rank = some.select("nid").distinct().withColumn("_one", F.lit(1))
    rank = rank.withColumn("_r", F.row_number().over(Window.partitionBy("_one").orderBy("nid")) - 1).drop("_one")
    return some.join(rank, "nid").join(F.broadcast(low)).select("sid", (F.col("_low") - F.col("_r")).alias("nid"))


def renumber(units: DataFrame, depth: Column, key: str = "nid") -> DataFrame:
    """New ids by depth: single units 1, 2, ..., multiunits -1, -2, ... (C16, W7, M10). A row per unit, so few rows."""
    w = Window.partitionBy(F.signum(F.col(key).cast("double"))).orderBy(depth, key)
    return units.filter(F.col(key) != 0).withColumn("new_nid", F.row_number().over(w) * F.signum(F.col(key).cast("double")).cast("long"))


def id_gaps(units: DataFrame, key: str = "nid") -> DataFrame:
    """Ids whose successor is not the next number (M4). A row per unit."""
    one = units.select(key).distinct().withColumn("_one", F.lit(1))
    return one.withColumn("next", F.lead(key).over(Window.partitionBy("_one").orderBy(key))).filter(F.col("next") - F.col(key) != 1).drop("_one")


def propagate(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """Roots of merge pointers ``(node, parent)`` by pointer jumping."""
    cur = parents.select("node", "parent")
    for _ in range(rounds):
        up = cur.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        nxt = cur.join(up, "parent", "left").select("node", "parent", F.coalesce("_up", "parent").alias("_new"))
        moved = nxt.filter("_new <> parent").limit(1).count()
        cur = nxt.select("node", F.col("_new").alias("parent"))
        if cur.sparkSession.sparkContext.getCheckpointDir():
            cur = cur.checkpoint()
        if not moved:
            return cur
    raise RuntimeError("pointers did not settle")
