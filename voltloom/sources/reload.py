"""Spike windows cut again from raw files.

Files are extents of samples on a common clock.  Windows meet extents in a
bucketed range join and become pieces with byte ranges.  Pieces are
range-sorted by file and offset, so a task holds a stretch of one file after
another, and near pieces share a read: a read grows while the bytes that no
piece asked for stay below a share of those asked for, and while it fits its
bound.  Windows that lie in one extent are cut whole; only those over the edge
of a file or a record are put together by a shuffle, with zeros where no extent
has samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import overlap_join
from .recordings import _open, layout
from .surf import ZERO_LEVEL, layouts

EXTENTS = "path string, e0 long, e1 long, offset long, nchans int, time_major boolean, gain double, zero int, echans array<int>"
PIECE = "sid long, ti0 long, ti1 long, chans array<int>, path string, a long, b long, e0 long, offset long, nchans int, time_major boolean, gain double, zero int, echans array<int>, place int, byte0 long, byte1 long"
CUT = "sid long, ti0 long, ti1 long, chans array<int>, a long, place int, data array<array<double>>"


def flat_extents(spark: SparkSession, paths: list[str], starts: list[int] | None = None) -> DataFrame:
    """An extent per flat file, from its header; ``starts`` are first samples on the common clock, else each file's own."""
    rows = []
    for k, p in enumerate(paths):
        lay = layout(p)
        a = lay.t0_samples if starts is None else starts[k]
        chans = (lay.chans + [-1] * lay.nchans)[: lay.nchans]  # recorded channels come first; others cannot be asked for
        rows.append((p, a, a + lay.nsamples, lay.offset, lay.nchans, not lay.extra.get("channel_major"), lay.uv_per_ad, 0, chans))
    return spark.createDataFrame(rows, EXTENTS)


def record_extents(index: DataFrame, rate: float, gain: float = 1.0, probe: int = 0) -> DataFrame:
    """An extent per continuous record of .srf files: channel after channel, numbered from 0."""
    shapes = layouts(index).filter(F.col("probe") == probe).select("file", F.col("nchans").alias("_n"))
    rows = index.filter((F.col("kind") == "PS") & (F.col("probe") == probe)).join(shapes, "file")
    first, n = F.rint(F.col("t") * rate / 1e6).cast("long"), F.floor(F.col("nsamples") / F.col("_n"))
    return rows.select(
        F.col("file").alias("path"), first.alias("e0"), (first + n).alias("e1"), F.col("offset"), F.col("_n").alias("nchans"), F.lit(False).alias("time_major"),
        F.lit(gain).alias("gain"), F.lit(ZERO_LEVEL).alias("zero"), F.sequence(F.lit(0), F.col("_n") - 1).alias("echans"),
    )


def pieces(windows: DataFrame, extents: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Byte ranges of ``windows(sid, ti0, ti1, chans)`` in the extents: one where channels are interleaved, else one a channel."""
    rows = overlap_join(windows.select("sid", "ti0", "ti1", "chans"), extents, width, "ti0", "ti1", "e0", "e1")
    rows = rows.withColumns({"a": F.greatest("ti0", "e0"), "b": F.least("ti1", "e1")})
    where = F.transform("chans", lambda c: F.array_position("echans", c).cast("int") - 1)
    places = F.when(F.col("time_major"), F.array(F.lit(-1))).otherwise(F.filter(where, lambda p: p >= 0))
    rows = rows.withColumn("place", F.explode(places))
    frame = F.when(F.col("time_major"), F.col("nchans")).otherwise(1)
    start = F.when(F.col("time_major"), 0).otherwise(F.col("place") * (F.col("e1") - F.col("e0")))
    at = lambda t: F.col("offset") + 2 * (start + frame * (F.col(t) - F.col("e0")))
    return rows.withColumns({"byte0": at("a"), "byte1": at("b")}).select(*[c.split()[0] for c in PIECE.split(", ")])


def coalesced(rows: Iterator[dict], slack: float, most: int) -> Iterator[tuple[str, int, int, int, list[dict]]]:
    """(path, first byte, last byte, bytes asked for, pieces): pieces sorted by (path, byte0) that share a read."""
    path, a, b, asked, held = "", 0, 0, 0, []
    for r in rows:
        new = max(0, r["byte1"] - max(b, r["byte0"]))
        if held and r["path"] == path and max(b, r["byte1"]) - a <= most and max(0, r["byte0"] - b) + (b - a) - asked <= slack * (asked + new):
            asked, b = asked + new, max(b, r["byte1"])
            held.append(r)
        else:
            if held:
                yield path, a, b, asked, held
            path, a, b, held = r["path"], r["byte0"], r["byte1"], [r]
            asked = b - a
    if held:
        yield path, a, b, asked, held


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _planned(df: DataFrame) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, "path", "byte0", "sid").sortWithinPartitions("path", "byte0", "byte1")


def read_plan(found: DataFrame, slack: float = 0.2, most: int = 1 << 23) -> DataFrame:
    """(path, byte0, byte1, asked, pieces): the reads that ``pieces`` lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(p, a, b, n, len(x)) for p, a, b, n, x in coalesced(_each(batches), slack, most)]
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "byte0", "byte1", "asked", "pieces"), r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("byte0", "byte1", "asked", "pieces")]]))

    return _planned(found).mapInArrow(run, "path string, byte0 long, byte1 long, asked long, pieces long")


def _cut(found: DataFrame, slack: float, most: int) -> DataFrame:
    """Samples in uV of every piece: channels of the window in their order, or the one channel at ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for path, first, last, _, held in coalesced(_each(batches), slack, most):
            store, p = _open(path)
            with store.open_input_file(p) as f:
                raw = np.frombuffer(f.read_at(last - first, first), "<i2")
            for r in held:
                x = raw[(r["byte0"] - first) // 2 : (r["byte1"] - first) // 2]
                x = x.reshape(-1, r["nchans"]).T[[r["echans"].index(c) for c in r["chans"]]] if r["time_major"] else x[None, :]
                x = (x.astype(float) - r["zero"]) * r["gain"]
                out.append({k: r[k] for k in ("sid", "ti0", "ti1", "chans", "a", "place")} | {"data": x.tolist()})
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=CUT_TYPES)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=CUT_TYPES)

    return _planned(found).mapInArrow(run, CUT)


CUT_TYPES = pa.schema([("sid", pa.int64()), ("ti0", pa.int64()), ("ti1", pa.int64()), ("chans", pa.list_(pa.int32())), ("a", pa.int64()), ("place", pa.int32()), ("data", pa.list_(pa.list_(pa.float64())))])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows from their pieces, zero where there is none."""
    for b in batches:
        waves = []
        for r in b.to_pylist():
            x = np.zeros((len(r["chans"]), r["ti1"] - r["ti0"]))
            for p in r["_p"]:
                rows = range(len(p["data"])) if p["place"] < 0 else [r["chans"].index(p["chan"])]
                for k, d in zip(rows, p["data"], strict=True):
                    x[k, p["a"] - r["ti0"] : p["a"] - r["ti0"] + len(d)] = d
            waves.append(x.tolist())
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(waves, pa.list_(pa.list_(pa.float64())))], names=["sid", "ti0", "ti1", "chans", "wave"])


def reload(windows: DataFrame, extents: DataFrame, slack: float = 0.2, most: int = 1 << 23) -> DataFrame:
    """(sid, ti0, ti1, chans, wave in uV) of ``windows(sid, ti0, ti1, chans)``, half open on the common clock.

    Samples outside all extents are zero, and so is a channel that an extent
    lacks; a window that meets no extent is all zero.  Ids are unique.
    """
    need = F.size(F.array_except("chans", "echans")) == 0
    found = pieces(windows, extents)
    whole = F.col("time_major") & (F.col("a") == F.col("ti0")) & (F.col("b") == F.col("ti1")) & need
    simple = _cut(found.filter(whole), slack, most).select("sid", "ti0", "ti1", "chans", F.col("data").alias("wave"))
    # of other windows each piece is cut to the channels that its extent has
    had = F.array_intersect("chans", "echans")
    rest = found.filter(~whole).withColumn("_all", F.col("chans")).withColumn("chans", had).filter(F.size("chans") > 0)
    one = F.when(F.col("place") < 0, F.col("chans")).otherwise(F.array(F.element_at("echans", F.col("place") + 1)))
    cut = _cut(rest.withColumn("chans", one).drop("_all"), slack, most)
    parts = cut.select("sid", F.explode(F.arrays_zip("chans", "data")).alias("_c"), "a")
    parts = parts.groupBy("sid").agg(F.collect_list(F.struct("a", F.lit(0).alias("place"), F.col("_c.chans").alias("chan"), F.array(F.col("_c.data")).alias("data"))).alias("_p"))
    others = windows.select("sid", "ti0", "ti1", "chans").join(found.filter(whole).select("sid"), "sid", "left_anti").join(parts, "sid", "left")
    others = others.withColumn("_p", F.coalesce("_p", F.array().cast(parts.schema["_p"].dataType)))
    names = ["sid", "ti0", "ti1", "chans", "wave"]
    return simple.unionByName(others.select("sid", F.col("ti0").cast("long"), F.col("ti1").cast("long"), F.col("chans").cast("array<int>"), "_p").mapInArrow(_together, "sid long, ti0 long, ti1 long, chans array<int>, wave array<array<double>>").select(*names))


def reclick(spikes: DataFrame, clicks: DataFrame, extents: DataFrame, rate: float, window_us: tuple[float, float] = (-500.0, 1000.0)) -> DataFrame:
    """Spikes set anew from ``clicks(sid, t, other, chan)``: primary and secondary peak times, and optionally another channel.

    Time, window, channel, sides of the peaks, voltages and the wave follow
    from the clicks; the position is fitted by ``spikes.relocate``.  Raises
    (``assert_true``) where both peaks are one or the channel is none of the spike's.
    """
    tres = 1e6 / rate
    base = spikes.select("sid", "chans", F.col("chan").alias("_old")).join(clicks, "sid")
    chan = F.coalesce(F.col("chan"), F.col("_old"))
    sound = (F.col("t") != F.col("other")) & F.array_contains("chans", chan)
    checked = F.when(F.assert_true(sound, F.lit("a spike needs two peaks and a channel of its own")).isNull(), F.col("t"))
    base = base.select("sid", "chans", checked.alias("t"), "other", chan.alias("chan"))
    sample = lambda us: F.rint((F.col("t") + us) / tres).cast("long")
    base = base.withColumns({"ti0": sample(window_us[0]), "ti1": sample(window_us[1])})
    waves = reload(base, extents).select("sid", "wave")
    row = F.element_at("wave", F.array_position("chans", F.col("chan")).cast("int"))
    at = lambda p: F.element_at(row, (F.rint(p / tres) - F.col("ti0") + 1).cast("int"))
    first, second = F.least("t", "other"), F.greatest("t", "other")
    out = base.join(waves, "sid").withColumns({"V0": at(first), "V1": at(second)})
    return out.select(
        "sid", "t", (F.col("t") + window_us[0]).cast("long").alias("t0"), (F.col("t") + window_us[1]).cast("long").alias("t1"), "chan", "chans",
        F.when(F.col("t") < F.col("other"), 0).otherwise(1).alias("aligni"), F.abs(F.col("other") - F.col("t")).cast("int").alias("dt"), "V0", "V1", F.abs(F.col("V1") - F.col("V0")).alias("Vpp"), "wave",
    )


def event_windows(events: DataFrame, near: DataFrame, rate: float, window_us: tuple[float, float] = (-500.0, 1000.0)) -> DataFrame:
    """Windows of imported events ``(sid, t, chan, nid)``: the neighbourhood ``near(chan, chans)`` of the largest channel."""
    sample = lambda us: F.rint((F.col("t") + us) * rate / 1e6).cast("long")
    return events.join(near, "chan").select("sid", "nid", "t", "chan", "chans", sample(window_us[0]).alias("ti0"), sample(window_us[1]).alias("ti1"))
