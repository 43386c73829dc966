"""Exports of recordings, stimulus records and spikes.

Recordings leave as flat sample files: every task writes the blocks it owns at
their places in one file (``positional``).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..operators import checks, metrics, signal
from ..operators import units as units_
from ..operators.streams import Stream, runs
from . import events, positional
from .recordings import _open


STRETCH = 4096


def without_ranges(samples: DataFrame, ranges: DataFrame, pad: int = 0, broadcast_rows: int = 100_000) -> DataFrame:
    """Samples, zero inside ``ranges(ti0, ti1)`` (half open) widened by ``pad`` samples on both sides.

    Ranges are merged and belong to every stretch of 4,096 samples they touch:
    one row a stretch, so samples meet them in one join on the stretch, and are compared in place.
    """
    wide = ranges.select((F.col("ti0") - pad).alias("_a"), (F.col("ti1") + pad).alias("_b")).filter("_a < _b")
    wide = wide.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_a") / STRETCH), F.floor((F.col("_b") - 1) / STRETCH))))
    cut = F.struct(F.greatest("_a", F.col("_s") * STRETCH).alias("a"), F.least("_b", (F.col("_s") + 1) * STRETCH).alias("b"))
    # cut to the stretch and made distinct, at most STRETCH ** 2 / 2 ranges are left of any number
    wide = wide.groupBy("_s").agg(F.collect_set(cut).alias("_in"))
    few = wide.count() <= broadcast_rows
    rows = samples.withColumn("_s", F.floor(F.col("ti") / STRETCH)).join(F.broadcast(wide) if few else wide, "_s", "left")
    hit = F.exists("_in", lambda r: (F.col("ti") >= r["a"]) & (F.col("ti") < r["b"]))
    return rows.withColumn("v", F.when(F.coalesce(hit, F.lit(False)), 0.0).otherwise(F.col("v"))).drop("_s", "_in")


def _to_int16(x: np.ndarray, uv_per_ad: float) -> bytes:
    """Samples in uV (moments x channels) as converter values."""
    x = np.rint(x / uv_per_ad)
    if np.abs(x).max(initial=0) > 32767:
        raise ValueError("samples do not fit int16")
    return x.astype("<i2").tobytes()


def _sidecar(path: str, chans: list[int], rate: float, uv_per_ad: float, probe: str, first: int, meta: dict) -> None:
    """The .dat.json, written last: a .dat without it is not finished."""
    store, p = _open(path)
    side = {"nchans": len(chans), "sample_rate": rate, "dtype": "int16", "uV_per_AD": uv_per_ad, "probe_name": probe, "chans": chans, "aux_chans": [], "nsamples_offset": first, **meta}
    with store.open_output_stream(p + ".json") as f:
        f.write(json.dumps(side, indent=1).encode())


def write_dat(
    samples: DataFrame, path: str, rate: float, uv_per_ad: float, probe: str, chans: list[int] | None = None, block: int = 65_536,
    saturated: DataFrame | None = None, pad: int = 0, **meta,
) -> int:
    """Long samples (chan, ti, v in uV) as a .dat file with sidecar; missing samples are zero.

    Blocks of ``block`` moments are dealt to tasks, which put each at its place
    in the file; a task holds one block.  ``saturated`` ranges (ti0, ti1),
    widened by ``pad``, are zeroed first.  Recordings that are frames already
    go by ``write_frames``, without a shuffle.  Returns the number of samples
    per channel.
    """
    if saturated is not None:
        samples = without_ranges(samples, saturated, pad)
    chans = chans or sorted(r[0] for r in samples.select("chan").distinct().collect())
    first, last = samples.agg(F.min("ti"), F.max("ti")).first()
    n = 0 if first is None else last - first + 1
    order = np.argsort(chans)
    names = np.array(chans)[order]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        now, x = None, None
        for b in batches:
            blk, ti, chan, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(blk)) + 1, [len(blk)]]) if len(blk) else np.zeros(0, np.int64)
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if blk[a] != now:
                    if x is not None:
                        yield 2 * len(chans) * block * now, _to_int16(x, uv_per_ad)
                    now = int(blk[a])
                    x = np.zeros((min(block, n - now * block), len(chans)))
                x[ti[a:z] - first - now * block, order[np.searchsorted(names, chan[a:z])]] = v[a:z]
        if x is not None:
            yield 2 * len(chans) * block * now, _to_int16(x, uv_per_ad)

    rows = samples.filter(F.col("chan").isin(chans)).select(F.floor((F.col("ti") - F.lit(first)) / block).alias("b"), "ti", "chan", F.col("v").cast("double"))
    positional.write(rows.repartition("b").sortWithinPartitions("b"), pieces, path, 2 * len(chans) * n)
    _sidecar(path, chans, rate, uv_per_ad, probe, int(first or 0), meta)
    return n


def write_frames(frames: DataFrame, path: str, rate: float, uv_per_ad: float, probe: str, chans: list[int], stream: Stream | None = None, **meta) -> int:
    """Frames of one recording as a .dat file with sidecar, by their tasks and without a shuffle.

    With a ``stream`` the samples are filtered, referenced and resampled as it
    says, frame by frame with their halo, and the sidecar describes it.  A
    channel that a frame lacks is zero, and so are moments of no frame; frames
    do not own the same moment twice.  Returns the number of samples per channel.
    """
    raw = stream.raw_rate if stream else rate
    up, down = stream.factors if stream else (1, 1)
    if stream and stream.rate != rate:
        raise ValueError(f"the stream has {stream.rate} Hz, not {rate}")
    ends = frames.agg(F.min("cut0_us"), F.max("cut1_us")).first()
    place = lambda us: -(-round(us * raw / 1e6) * up // down)
    # the last frame may own less than its cut says: count what there is
    spans = frames.select(F.least("cut1_us", F.col("t0_us") + F.size(F.col("data")[0]) * F.col("tres_us")).alias("z")).agg(F.max("z")).first()[0]
    first, n = (place(ends[0]), place(spans) - place(ends[0])) if ends[0] is not None else (0, 0)
    if stream:
        meta = {**stream.describe(), **meta}
        meta.pop("sample_rate", None)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for b in batches:
            for f in b.to_pylist():
                x, names, at = np.array(f["data"], float), list(f["chans"]), round(f["t0_us"] * raw / 1e6)
                lo, hi = place(f["cut0_us"]), min(place(f["cut1_us"]), first + n)
                out = np.zeros((hi - lo, len(chans)))
                found = [(k, names.index(c)) for k, c in enumerate(chans) if c in names]
                for a, z in runs(~np.isnan(x).all(0)):
                    y = np.nan_to_num(x[:, a:z])
                    if stream:
                        y = stream.process(y, np.array(names))
                    ti = (at + a) * up + np.arange(y.shape[1])
                    keep = (ti % down == 0) & (ti // down >= lo) & (ti // down < hi)
                    for k, c in found:
                        out[ti[keep] // down - lo, k] = y[c, keep]
                yield 2 * len(chans) * (lo - first), _to_int16(out, uv_per_ad)

    cols = ["t0_us", "cut0_us", "cut1_us", "chans", "data"]
    positional.write(frames.select(*cols), pieces, path, 2 * len(chans) * n)
    _sidecar(path, chans, rate, uv_per_ad, probe, first, meta)
    return n


def envelope(samples: DataFrame, rate: float, cutoff_hz: float = 500.0, to_rate: float = 2000.0, block: int = 250_000, halo: int = 5000) -> DataFrame:
    """(chan, ti, v): rectified, lowpass filtered, every (rate / to_rate)-th sample; by block with halo, unbroken runs each by themselves.

    For a bipolar reference take the difference of channels first."""
    every = max(1, round(rate / to_rate))
    b, a = filters.butterworth(4, cutoff_hz, rate, "lowpass")
    rows = samples.withColumn("_b", F.explode(F.sequence(F.greatest(F.floor((F.col("ti") - halo) / block), F.lit(0)), F.floor((F.col("ti") + halo) / block))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ti")
        v, cuts = np.abs(pdf["v"].to_numpy(float)), np.flatnonzero(np.diff(pdf["ti"].to_numpy()) != 1) + 1
        v = np.concatenate([filters.filtfilt(b, a, x[None, :])[0] for x in np.split(v, cuts)])
        keep = ((pdf["ti"] // block) == pdf["_b"]).to_numpy() & (pdf["ti"] % every == 0).to_numpy()
        return pd.DataFrame({"chan": pdf["chan"].to_numpy()[keep], "ti": pdf["ti"].to_numpy()[keep], "v": v[keep]})

    return rows.groupBy("chan", "_b").applyInPandas(run, "chan int, ti long, v double")


def write_long(samples: DataFrame, folder: str, kind: str = "csv") -> None:
    """A lowpass or envelope recording as CSV or Parquet files in sample order."""
    out = samples.select("chan", "ti", "v").repartitionByRange("ti").sortWithinPartitions("ti", "chan")
    getattr(out.write.mode("errorifexists").option("header", True) if kind == "csv" else out.write, kind)(folder)


def _each(rows: DataFrame, folder: str, name, body) -> None:
    """A file per row, written by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, p = _open(folder)
        for b in batches:
            for r in b.to_pylist():
                part = f"{p}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(body(r))
                store.move(part, f"{p}/{name(r)}")
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    store, p = _open(folder)
    store.create_dir(p)
    rows.mapInArrow(run, "n long").collect()


def _base(r: dict) -> str:
    return f"{os.path.splitext(os.path.basename(r['file']))[0]}_{r['display']}"


def write_din(index: DataFrame, folder: str) -> None:
    """A .din file of (time, value) pairs per display record (K5)."""
    from .surf import stimulus_edges

    rows = stimulus_edges(index).groupBy("file", "display").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("pairs"))
    _each(rows, folder, lambda r: f"{_base(r)}.din", lambda r: np.array([(x["t"], x["value"]) for x in r["pairs"]], "<i8").tobytes())


def write_text_headers(index: DataFrame, folder: str) -> None:
    """A .textheader file per display record (K6)."""
    from .surf import text_headers

    _each(text_headers(index), folder, lambda r: f"{_base(r)}.textheader", lambda r: r["text"].encode())


def write_all(index: DataFrame, folder: str) -> None:
    """Stimulus edges and text headers of a recording (K7; spikes: ``events.write_ptcs``)."""
    write_din(index, folder)
    write_text_headers(index, folder)


def check_units(spikes: DataFrame, units: DataFrame, waves: DataFrame, trigger: DataFrame, least_us: int = 50, most_shift: int = 1, most_padded: int = 5) -> None:
    """Raise with all that an export must not hold (K2, M1-M4).

    Intervals of a good unit below ``least_us``; templates ``waves(nid, chan,
    ti, v)`` whose main channel, in ``trigger(nid, chan, at)``, has no extreme
    near its trigger; templates with more than ``most_padded`` equal samples at
    an end of the main channel; and ids of units with numbers left out.
    """
    good = units.filter("good").select("nid")
    mine = lambda df: df.join(good, "nid", "left_semi")
    found = []
    short = metrics.isi_violations(mine(spikes).select("nid", "t", "sid"), least_us)
    main = mine(waves).join(trigger.select("nid", "chan"), ["nid", "chan"])
    edges = signal.constant_edges(main, ["nid"], ["ti"])
    for what, bad in (
        ("intervals too short", short),
        ("templates off their trigger", checks.misaligned_templates(mine(waves), mine(trigger), most_shift)),
        ("padded templates", edges.filter((F.col("lead_n") > most_padded) | (F.col("trail_n") > most_padded))),
        ("ids left out after", units_.id_gaps(units.filter("nid > 0"))),
    ):
        if some := sorted({r.nid for r in bad.select("nid").limit(20).collect()}):
            found.append(f"{what}: units {some}")
    if found:
        raise ValueError("; ".join(found))


def export_units(spikes: DataFrame, units: DataFrame, recordings: list[tuple[str, int, int]], folder: str, rate: int = 25000, checked: tuple[DataFrame, DataFrame] | None = None) -> dict[str, int]:
    """A .ptcs file per recording (name, t0, t1 on the track's clock), with times from the recording's start; units written of each (K1, K7).

    ``checked`` are templates and triggers for ``check_units``, which must pass first.
    """
    if checked:
        check_units(spikes, units, *checked)
    store, p = _open(folder)
    store.create_dir(p)
    return {name: events.write_ptcs(spikes, units, f"{folder}/{name}.ptcs", t0, t1, name, rate) for name, t0, t1 in recordings}


def tschid(spikes: DataFrame) -> DataFrame:
    """(t, chan, nid) in time order (K4)."""
    return spikes.select("t", "chan", "nid").orderBy("t", "chan")


def spike_waves(spikes: DataFrame, chans: list[int], first: int, last: int) -> DataFrame:
    """(sid, flat): samples [first, last) of the waves on common channels, one channel after the other (K8).

    Spikes that lack one of the channels are left out.
    """
    at = [F.array_position("chans", F.lit(c)).cast("int") for c in chans]
    cut = [F.slice(F.element_at("wave", F.when(k > 0, k)), F.lit(first + 1), F.lit(last - first)) for k in at]
    return spikes.filter(F.forall(F.array(*at), lambda k: k > 0)).select("sid", F.concat(*cut).alias("flat"))


def channel_map(sites: list[tuple[int, float, float]]) -> list[tuple]:
    """Rows (one-based, zero-based, channel, x, y, shank) of a sorter's channel map, in file order."""
    return [(k + 1, k, c, x, y, 1) for k, (c, x, y) in enumerate(sites)]


def channel_map_file(dat: str) -> str:
    """Where the channel map of a .dat file lies; ``matfiles.write_channel_map`` writes it."""
    return f"{dat}.chanmap.mat"


def kilosort_config(dat: str, nchans: int, rate: float, **options) -> str:
    """A configuration script of a spike sorter for a .dat file."""
    settings = {"NchanTOT": nchans, "fs": rate, "fbinary": f"'{dat}'", "chanMap": f"'{channel_map_file(dat)}'", **options}
    return "".join(f"ops.{k} = {v};\n" for k, v in settings.items())
