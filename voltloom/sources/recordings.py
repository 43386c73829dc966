"""Readers and writers of recording files as Spark data sources and DataFrames.

Flat sample files are cut into byte ranges that tasks read on their own; small
headers are parsed on the driver. Paths may lie in any store that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

REQUIRED = ("nchans", "sample_rate", "dtype", "uV_per_AD")


def _open(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def read_bytes(path: str, offset: int = 0, size: int | None = None) -> bytes:
    store, p = _open(path)
    with store.open_input_file(p) as f:
        return f.read_at(f.size() - offset if size is None else size, offset)


@dataclass
class Layout:
    """Where the samples of a flat time-major int16 file lie, and what they mean."""

    path: str
    nchans: int
    rate: float
    uv_per_ad: float
    offset: int = 0
    nsamples: int = 0
    chans: list[int] = field(default_factory=list)
    aux: list[int] = field(default_factory=list)
    probe: str | None = None
    t0_samples: int = 0
    extra: dict = field(default_factory=dict)


def dat_layout(path: str) -> Layout:
    """A .dat file and its .dat.json (S1-S3): required keys, int16 only, whole frames only."""
    meta = json.loads(read_bytes(path + ".json"))
    meta.setdefault("probe_name", meta.pop("chan_layout_name", None))
    missing = [k for k in REQUIRED if k not in meta]
    if missing or not meta["probe_name"]:
        raise ValueError(f"{path}.json lacks {missing or ['probe_name']}")
    if meta["dtype"] != "int16":
        raise ValueError(f"{path}: dtype {meta['dtype']}")
    store, p = _open(path)
    size, n = store.get_file_info(p).size, int(meta["nchans"])
    if size % (2 * n):
        raise ValueError(f"{path}: {size} bytes are not whole frames of {n} channels")
    aux = meta.get("aux_chans") or []
    chans = meta.get("chans") or [c for c in range(n) if c not in aux]
    known = {"nchans", "sample_rate", "dtype", "uV_per_AD", "probe_name", "chans", "aux_chans", "nsamples_offset"}
    return Layout(path, n, float(meta["sample_rate"]), float(meta["uV_per_AD"]), 0, size // (2 * n), chans, aux, meta["probe_name"],
                  int(meta.get("nsamples_offset") or 0), {k: v for k, v in meta.items() if k not in known})


def write_dat(path: str, data: np.ndarray, rate: float, uv_per_ad: float, probe: str, chans: list[int] | None = None, **meta) -> None:
    """A .dat file with sidecar from (channels x samples) int16."""
    data = np.asarray(data)
    if data.dtype != np.int16:
        raise ValueError("samples must be int16")
    store, p = _open(path)
    with store.open_output_stream(p) as f:
        f.write(np.ascontiguousarray(data.T).tobytes())
    side = {"nchans": data.shape[0], "sample_rate": rate, "dtype": "int16", "uV_per_AD": uv_per_ad, "probe_name": probe,
            "chans": chans or list(range(data.shape[0])), "aux_chans": [], "nsamples_offset": 0, **meta}
    with store.open_output_stream(p + ".json") as f:
        f.write(json.dumps(side, indent=1).encode())


def nsx_layout(path: str) -> Layout:
    """A NEURALCD file with one data packet (S4, S6): basic header, a CC header per channel, packet header."""
    head = read_bytes(path, 0, 314)
    kind, major, minor, size, label, _, period, clock = struct.unpack("<8sBBI16s256sII", head[:294])
    if kind != b"NEURALCD":
        raise ValueError(f"{path}: {kind!r}")
    n = struct.unpack("<I", head[310:314])[0]
    chans, aux, gains, labels = [], [], [], []
    raw = read_bytes(path, 314, 66 * n)
    for k in range(n):
        tag, cid, name, _, _, dmin, dmax, amin, amax, unit = struct.unpack("<2sH16sBBhhhh16s", raw[66 * k : 66 * k + 46])
        if tag != b"CC":
            raise ValueError(f"{path}: channel header {tag!r}")
        name, unit = (s.split(b"\0")[0].decode() for s in (name, unit))
        (chans if re.fullmatch(r"chan%d" % cid, name) else aux).append(cid)
        labels.append(name)
        if name == f"chan{cid}":
            gains.append((amax - amin) / (dmax - dmin) * (1 if unit == "uV" else 1000))
    if gains and max(gains) != min(gains):
        raise ValueError(f"{path}: channels differ in gain")
    packet = read_bytes(path, size, 9)
    flag, t0, count = struct.unpack("<BII", packet)
    store, p = _open(path)
    if flag != 1 or size + 9 + 2 * n * count != store.get_file_info(p).size:
        raise ValueError(f"{path}: pauses or a cut file")
    return Layout(path, n, clock / period, gains[0] if gains else 1.0, size + 9, count, chans, aux, None, t0, {"labels": labels})


#: Channels that files of version 1000 always have.
TSF_1000_CHANNELS = 54


def tsf_layout(path: str) -> Layout:
    """A .tsf file of version 1000 or 1002 (S18, S19): sites, gains, samples channel after channel, and ground truth behind them.

    ``extra["truth"]`` holds where the truth's three columns begin, how many
    spikes it has and the type of its numbers; None where there is none.
    """
    magic, version = struct.unpack("<16si", read_bytes(path, 0, 20))
    if magic != b"Test spike file ":
        raise ValueError(f"{path}: {magic!r}")
    store, p = _open(path)
    size = store.get_file_info(p).size
    if version == 1002:
        rate, n, count, gain = struct.unpack("<iiif", read_bytes(path, 20, 16))
        table = np.frombuffer(read_bytes(path, 36, 8 * n), np.dtype([("site", "<i2", 2), ("place", "<i4")]))
        sites, extra, at = table["site"].tolist(), {"places": table["place"].tolist(), "int_gain": 1, "ext_gain": gain}, 36 + 8 * n
    elif version == 1000:
        n = TSF_1000_CHANNELS
        sites = np.frombuffer(read_bytes(path, 20, 4 * n), "<i2").reshape(n, 2).tolist()
        rate, clock, *gains, gain, n2, count = struct.unpack("<ii64HHii", read_bytes(path, 20 + 4 * n, 146))
        if n2 != n:
            raise ValueError(f"{path}: {n2} channels, not {n}")
        extra, at = {"clock": clock, "int_gain": gain, "ext_gain": gains[0]}, 20 + 4 * n + 146
    else:
        raise ValueError(f"{path}: version {version}")
    end = at + 2 * n * count
    if end > size:
        raise ValueError(f"{path}: the file ends inside its samples")
    head = 4 if version == 1002 else 8
    truth = None
    if size >= end + head and (spikes := struct.unpack("<i", read_bytes(path, end + head - 4, 4))[0]):
        truth = (end + head, spikes, "<i4" if version == 1002 else "<u4")
    bits = 15 if version == 1002 else 11  # version 1000 has twelve-bit samples
    return Layout(path, n, float(rate), 1e7 / (2**bits * extra["int_gain"] * extra["ext_gain"]), at, count, list(range(n)), [], None, 0, {"sites": sites, "version": version, "channel_major": True, "truth": truth, **extra})


def tsf_truth(spark: SparkSession, path: str) -> DataFrame:
    """(sid, ti, nid, chan) of the simulated spikes behind a .tsf file's samples, in time order, channels from zero; read by ranges."""
    from . import arrays

    truth = tsf_layout(path).extra["truth"]
    if truth is None:
        return spark.createDataFrame([], "sid long, ti long, nid long, chan int")
    at, n, dtype = truth
    got = arrays.rows(spark, {c: (path, f"@raw:{at + 4 * n * k}:{n}:{dtype}") for k, c in enumerate(("ti", "nid", "chan"))})
    zero = F.when(F.assert_true(F.col("chan") >= 1, F.lit("channels of the truth start at one")).isNull(), F.col("chan") - 1).cast("int")
    return got.select(F.col("row").alias("sid"), "ti", "nid", zero.alias("chan")).orderBy("ti", "sid")


def nsx_sidecar(path: str, templates: list[str] = ()) -> dict:
    """Probe and adapter of an .nsx file (S5): from its .ns6.json, else the first of ``templates`` that lies beside it."""
    store, p = _open(path)
    folder, _, name = p.rpartition("/")
    own = f"{re.sub(r'[.]ns[0-9]$', '', name)}.ns6.json"
    for side in (own, *templates):
        at = f"{folder}/{side}" if folder else side
        if store.get_file_info(at).is_file:
            with store.open_input_file(at) as f:
                meta = json.loads(f.read())
            if odd := sorted(set(meta) - {"probe_name", "chan_layout_name", "adapter_name"}):
                raise ValueError(f"{side} has the fields {odd}")
            probe = meta.get("probe_name") or meta.get("chan_layout_name")
            if not probe:
                raise ValueError(f"{side} names no probe")
            return {"probe": probe, "adapter": meta.get("adapter_name")}
    raise ValueError(f"{path} has neither {own} nor one of {list(templates)} beside it")


def channel(lay: Layout, key: int | str) -> int:
    """Place of a channel in the file's frames, by its id or its label."""
    if isinstance(key, int):
        every = [*lay.chans, *lay.aux]
        if key in every:
            return every.index(key)
    elif key in lay.extra.get("labels", []):
        return lay.extra["labels"].index(key)
    raise KeyError(f"{lay.path} has no channel {key!r}")


LAYOUTS = {".dat": dat_layout, ".ns6": nsx_layout, ".tsf": tsf_layout}


def layout(path: str) -> Layout:
    """Dispatch by extension."""
    for ext, f in LAYOUTS.items():
        if path.endswith(ext):
            return f(path)
    raise ValueError(f"no reader for {path}")


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SampleReader(DataSourceReader):
    def __init__(self, options):
        self.layout = layout(options["path"])
        self.halo = int(options.get("halo", 200))
        self.aux = str(options.get("aux", "false")).lower() == "true"
        self.per_block = max(1, int(float(options.get("block_s", 10)) * self.layout.rate))

    def partitions(self):
        n = self.layout.nsamples
        return [_Range(a, min(a + self.per_block, n)) for a in range(0, max(n, 1), self.per_block)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        lay = self.layout
        a, b = max(0, part.first - self.halo), min(lay.nsamples, part.last + self.halo)
        if b <= a:
            return
        if lay.extra.get("channel_major"):
            x = np.stack([np.frombuffer(read_bytes(lay.path, lay.offset + 2 * (c * lay.nsamples + a), 2 * (b - a)), "<i2") for c in range(lay.nchans)])
        else:
            x = np.frombuffer(read_bytes(lay.path, lay.offset + 2 * lay.nchans * a, 2 * lay.nchans * (b - a)), "<i2").reshape(-1, lay.nchans).T
        tres = 1e6 / lay.rate
        keep = range(len(lay.chans) + (len(lay.aux) if self.aux else 0))  # recorded channels come first, then the others
        row = {
            "rec": [lay.path], "block": [part.first // self.per_block], "t0_us": [(lay.t0_samples + a) * tres], "tres_us": [tres],
            "cut0_us": [(lay.t0_samples + part.first) * tres], "cut1_us": [(lay.t0_samples + part.last) * tres],
            "chans": [[*lay.chans, *(lay.aux if self.aux else [])]], "data": [[(x[k] * lay.uv_per_ad).tolist() for k in keep]],
        }
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64()))]
        yield pa.record_batch([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


class SampleSource(DataSource):
    """``spark.read.format("samples").option("path", ...)``: frames of a recording, a partition per block with halo."""

    @classmethod
    def name(cls):
        return "samples"

    def schema(self):
        return "rec string, block bigint, t0_us double, tres_us double, cut0_us double, cut1_us double, chans array<int>, data array<array<double>>"

    def reader(self, schema):
        return SampleReader(self.options)


def frames(spark: SparkSession, path: str, block_s: float = 10, halo: int = 200, aux: bool = False) -> DataFrame:
    """Frames of a recording; with ``aux`` the auxiliary channels come after the recorded ones."""
    spark.dataSource.register(SampleSource)
    return spark.read.format("samples").option("path", path).option("block_s", block_s).option("halo", halo).option("aux", str(aux).lower()).load()


def samples(frames_: DataFrame) -> DataFrame:
    """Long rows (rec, chan, ti, v) of the samples that each block owns."""
    a = F.greatest(F.lit(0), F.rint((F.col("cut0_us") - F.col("t0_us")) / F.col("tres_us"))).cast("int")
    n = F.rint((F.col("cut1_us") - F.col("cut0_us")) / F.col("tres_us")).cast("int")
    rows = frames_.select("rec", F.rint(F.col("cut0_us") / F.col("tres_us")).cast("long").alias("_t"), F.explode(F.arrays_zip("chans", F.transform("data", lambda d: F.slice(d, a + 1, n)).alias("d"))).alias("_c"))
    rows = rows.select("rec", "_t", F.col("_c").getField("chans").alias("chan"), F.posexplode(F.col("_c").getField("d")).alias("_k", "v"))
    return rows.select("rec", "chan", (F.col("_t") + F.col("_k")).alias("ti"), "v")


def track(path: str) -> tuple[list[str], list[int] | None]:
    """Members and enabled channels of a .track file (S17); the list is parsed, never evaluated."""
    import ast

    files, chans = [], None
    for line in read_bytes(path).decode().splitlines():
        line = line.strip()
        if m := re.match(r"#\s*enabledchans\s*=\s*(\[.*\])", line):
            chans = [int(c) for c in ast.literal_eval(m[1])]
        elif line and not line.startswith("#"):
            files.append(line)
    return files, chans


def write_track(path: str, files: list[str], chans: list[int] | None = None) -> None:
    """K18."""
    store, p = _open(path)
    text = (f"# enabledchans = {sorted(chans)}\n" if chans else "") + "".join(f"{f}\n" for f in files)
    with store.open_output_stream(p) as f:
        f.write(text.encode())


def track_frames(spark: SparkSession, paths: list[str], starts_us: list[float], block_s: float = 10) -> DataFrame:
    """Recordings on a common clock (U1, U2): equal gain and rate, starts in order."""
    lays = [layout(p) for p in paths]
    if len({(x.uv_per_ad, x.rate, tuple(x.chans)) for x in lays}) > 1:
        raise ValueError("recordings differ in gain, rate or channels")
    if list(starts_us) != sorted(starts_us):
        raise ValueError("recordings are not in order")
    out = None
    for p, t in zip(paths, starts_us, strict=True):
        f = frames(spark, p, block_s)
        f = f.select(*[(F.col(c) + float(t - starts_us[0])).alias(c) if c in ("t0_us", "cut0_us", "cut1_us") else F.col(c) for c in f.columns])
        out = f if out is None else out.unionByName(f)
    return out
