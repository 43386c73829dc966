"""Spike files: npz and npy imports, the .ptcs export, text exports."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, positional
from .recordings import _open


def events_zip(spark: SparkSession, path: str, rows_a_task: int = 250_000) -> DataFrame:
    """(sid, t, chan, nid) of an .events.zip (S22), read by ranges."""
    have = arrays.catalog(path)
    if missing := [k for k in ("spikets", "maxchans", "nids") if k not in have]:
        raise ValueError(f"{path} lacks {missing}")
    got = arrays.rows(spark, {k: (path, k) for k in ("spikets", "maxchans", "nids")}, rows_a_task)
    return got.select(F.col("row").alias("sid"), F.rint("spikets").cast("long").alias("t"), F.col("maxchans").cast("int").alias("chan"), F.col("nids").cast("long").alias("nid"))


def eventwaves_zip(spark: SparkSession, path: str, rows_a_task: int = 250_000) -> DataFrame:
    """(sid, t, chan, chans, wave in uV) of an .eventwaves.zip, read by ranges, with defaults for optional arrays.

    Without times, waves follow one another; without channels, they are the
    first ones; without a number of them, all; without a largest channel, the
    one of the largest peak-to-peak, the first of equals.
    """
    have = arrays.catalog(path)
    if missing := [k for k in ("wavedata", "uVperAD", "sampfreq") if k not in have]:
        raise ValueError(f"{path} lacks {missing}")
    _, m, nt = have["wavedata"].shape
    uv, rate = (float(arrays.values(have[k]).ravel()[0]) for k in ("uVperAD", "sampfreq"))
    optional = [k for k in ("t", "chans", "nchans", "chan") if k in have]
    got = arrays.rows(spark, {k: (path, k) for k in ("wavedata", *optional)}, rows_a_task)
    n = F.col("nchans").cast("int") if "nchans" in have else F.lit(m)
    chans = F.slice(F.transform("chans", lambda c: c.cast("int")) if "chans" in have else F.sequence(F.lit(0), F.lit(m - 1)), F.lit(1), n)
    wave = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.transform(F.slice("wavedata", k * nt + 1, F.lit(nt)), lambda v: v.cast("double") * uv))
    t = F.col("t") if "t" in have else F.col("row") * (nt * 1e6 / rate)
    out = got.select(F.col("row").alias("sid"), F.rint(t).cast("long").alias("t"), F.col("chan").cast("int").alias("chan") if "chan" in have else F.lit(None).cast("int").alias("chan"), chans.alias("chans"), F.slice(wave, F.lit(1), n).alias("wave"))
    height = F.transform("wave", lambda w: F.array_max(w) - F.array_min(w))
    top = F.element_at("chans", F.array_position(height, F.array_max(height)).cast("int"))
    return out.withColumn("chan", F.coalesce("chan", top))


def kilosort(spark: SparkSession, folder: str, raw_times: DataFrame, shift_us: float = -66.67, rows_a_task: int = 250_000) -> DataFrame:
    """Spikes of a Kilosort result (S23, J12): sample index to time by an equi-join with ``raw_times(ti, t)``; unit ids from 1; max channel of the template.

    Spikes are read by ranges; the templates, which do not grow with them, by the driver.
    """
    small = lambda f: arrays.values(arrays.catalog(f"{folder}/{f}.npy")["data"])
    top = small("channel_map").ravel()[np.abs(small("templates")).max(axis=1).argmax(axis=1)]
    one = lambda c: F.element_at(c, 1) if dict(got.dtypes)[c].startswith("array") else F.col(c)
    got = arrays.rows(spark, {"ti": (f"{folder}/spike_times.npy", "data"), "cl": (f"{folder}/spike_clusters.npy", "data")}, rows_a_task)
    spikes = got.select(F.col("row").alias("sid"), one("ti").cast("long").alias("ti"), one("cl").cast("long").alias("cl"))
    chans = spark.createDataFrame(pd.DataFrame({"cl": np.arange(len(top)), "chan": top.astype("int32")}), "cl long, chan int")
    out = spikes.join(raw_times, "ti").join(F.broadcast(chans), "cl", "left")
    return out.select("sid", F.rint(F.col("t") + shift_us).cast("long").alias("t"), "chan", (F.col("cl") + 1).alias("nid"))


def pad8(data: bytes) -> bytes:
    """Null padding to a multiple of 8 bytes."""
    return data + b"\0" * (-len(data) % 8)


#: Bytes of a neuron record before its spike times.
NEURON_HEAD = 8 + 8 + 32 + 40 + 16
#: Into how many stretches of time a unit's spikes are cut for writing.
STRETCHES = 4096


def write_ptcs(spikes: DataFrame, units: DataFrame, path: str, t0: int, t1: int, description: str = "", rate: int = 25000) -> int:
    """Version 3 .ptcs of good units, times relative to the stream's start and cut to [t0, t1) (K1).

    Units with spikes there are written by rising id; returns their number.
    Spike counts give every record its place in the file, and counts by unit
    and stretch of time the place of every stretch in it, so a large unit is
    written by many tasks.
    """
    good = units.filter("good").select(F.col("nid").cast("long").alias("nid"), "x0", "y0")
    inside = spikes.filter((F.col("t") >= t0) & (F.col("t") < t1)).select(F.col("nid").cast("long").alias("nid"), (F.col("t") - t0).cast("long").alias("t"), F.col("chan").cast("long").alias("chan"))
    records = inside.groupBy("nid").agg(F.count(F.lit(1)).alias("n"), F.min("chan").alias("chan")).join(good, "nid")
    text = pad8(description.encode())
    start = 16 + len(text) + 32
    # a row per unit: running sums of record sizes are the records' places
    placed = records.withColumn("at", start + F.sum(NEURON_HEAD + 8 * F.col("n")).over(Window.orderBy("nid")) - NEURON_HEAD - 8 * F.col("n"))
    total, n, size = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.col("at") + NEURON_HEAD + 8 * F.col("n")), F.lit(start))).first()
    width = max(1, (t1 - t0) // STRETCHES)
    inside = inside.withColumn("b", F.floor(F.col("t") / width))
    runs = inside.groupBy("nid", "b").agg(F.count(F.lit(1)).alias("k"))
    runs = runs.withColumn("before", F.sum("k").over(Window.partitionBy("nid").orderBy("b")) - F.col("k"))
    runs = runs.join(placed.select("nid", "at"), "nid").select("nid", "b", (F.col("at") + NEURON_HEAD + 8 * F.col("before")).alias("to"))
    rows = inside.select("nid", "b", "t").join(runs, ["nid", "b"]).repartition("to").sortWithinPartitions("to", "t").select("to", "t")
    heads = placed.select("nid", "at", "n", "chan", "x0", "y0")

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        now, done = None, 0
        for b in batches:
            to, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(0, np.int64)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if to[a] != now:
                    now, done = int(to[a]), 0
                yield now + 8 * done, t[a:z].astype("<i8").tobytes()
                done += z - a

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for b in batches:
            for r in b.to_pylist():
                yield r["at"], struct.pack("<qQ", r["nid"], 0) + struct.pack("<dddd", 0.0, r["x0"], r["y0"], 0.0) + struct.pack("<QQQQQ", 1, r["chan"], 0, 8, 0) + struct.pack("<QQ", 0, r["n"])

    first = struct.pack("<qQ", 3, len(text)) + text + struct.pack("<QQQQ", total, n, 8, rate)
    positional.write_all([(rows, times), (heads, head)], path, size, [(0, first)], whole=size)
    return total


def csv_rows(spikes: DataFrame, units: DataFrame) -> DataFrame:
    """Lines ``t in s with six decimals, nid, chan`` of good spikes, by unit and time (K3)."""
    good = spikes.join(units.filter("good").select("nid"), "nid", "left_semi")
    return good.orderBy("nid", "t").select(F.format_string("%.6f", F.col("t") / 1e6).alias("t"), "nid", "chan")


def save_session(tables: dict[str, DataFrame], folder: str) -> None:
    """A project folder of Parquet tables (K16), which may be read from it too.

    Tables are written under new names; the list of the session's tables is
    replaced last, so a session that fails to be saved is the one before.  What
    the list no longer names is removed then; tables that are not given stay.
    """
    store, p = _open(folder)
    store.create_dir(p)
    listed = _session(folder)
    new = dict(listed)
    for name, df in tables.items():
        new[name] = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{folder}/{new[name]}")
    part = f"{p}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(new, indent=1).encode())
    store.move(part, f"{p}/session.json")
    for name, at in listed.items():
        if new[name] != at:
            store.delete_dir(f"{p}/{at}")


def _session(folder: str) -> dict[str, str]:
    """Where each table of a session lies; nothing for a folder that lists none."""
    store, p = _open(folder)
    at = f"{p}/session.json"
    if not store.get_file_info(at).is_file:
        return {}
    with store.open_input_file(at) as f:
        return json.loads(f.read())


def load_session(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Unit ids come from the assignments, which win over those in the spike table."""
    listed = _session(folder)
    out = {n: spark.read.parquet(f"{folder}/{listed.get(n, n)}") for n in names}
    if {"spikes", "assignments"} <= set(out):
        s = out["spikes"].drop("nid").join(out["assignments"].select("sid", "nid"), "sid", "left")
        out["spikes"] = s.withColumn("nid", F.coalesce("nid", F.lit(0)))
    return out


def update_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace rows by key: those not renewed, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


MIGRATIONS = [
    ("0.5", lambda df: df.withColumnsRenamed({"phasetis": "tis", "dphase": "dt"}).drop("cid", "s0", "s1"), "0.6"),
    ("0.9", lambda df: df.withColumns({"lockchans": F.col("chans"), "nlockchans": F.size("chans")}) if "lockchans" not in df.columns else df, "1.0"),
    ("1.3", lambda df: df.withColumn("tres", F.lit(None).cast("double")) if "tres" not in df.columns else df, "1.4"),
    ("2.0", lambda df: df.withColumn("user", F.lit("")).withColumn("notes", F.lit("")), "2.1"),
]


def migrate(df: DataFrame, version: str, to: str = "2.1") -> DataFrame:
    """Bring a spike table of an older session format up to date (V1-V13); those of settings alone are in ``migrate_settings``."""
    number = lambda v: tuple(map(int, v.split(".")))
    if number(version) < (0, 3) or number(version) > number(to):
        raise ValueError(f"no way from version {version} to {to}")
    for start, step, end in MIGRATIONS:
        if number(version) <= number(start) and number(end) <= number(to):
            df = step(df)
    return df


#: Settings that a format adds, with their value in older sessions; a stored value stays.
ADDED_SETTINGS = [("0.6", "tw", (-500, 500)), ("0.8", "filtmeth", None), ("1.0", "car", None), ("1.1", "adapter", None), ("2.0", "user", ""), ("2.0", "notes", "")]


def migrate_settings(settings: dict, version: str, to: str = "2.1", renamed: dict[str, str] | None = None) -> dict:
    """Bring the settings of an older session up to date (V2, V4, V6, V8-V10, V13); ``renamed`` maps old probe names."""
    number = lambda v: tuple(map(int, v.split(".")))
    if number(version) < (0, 3) or number(version) > number(to):
        raise ValueError(f"no way from version {version} to {to}")
    out = dict(settings)
    if number(version) <= (0, 4):
        out = {"fname" if k == "sortfname" else k: v for k, v in out.items()}
    for start, name, value in ADDED_SETTINGS:
        if number(version) <= number(start) < number(to):
            out.setdefault(name, value)
    if number(version) <= (1, 2) and renamed and out.get("probe") in renamed:
        out["probe"] = renamed[out["probe"]]
    return out
