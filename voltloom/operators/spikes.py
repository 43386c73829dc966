"""Spike detection over frames of recordings, one task per block.

``frames`` has a row per (recording, block): rec, block, t0_us (time of the
first sample), tres_us, cut0_us and cut1_us (half-open range that the block
owns), chans array<int>, data array<array<double>> in uV. The samples around
the owned range are a halo, so filters settle and spikes at edges are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters, fits


@dataclass(frozen=True)
class Settings:
    """Detection and preprocessing parameters, immutable: other settings are another plan."""

    filter: str | None = "butter"  # butter (causal), butter-zero-phase, wavelet or None
    car: str | None = "median"
    resample: int = 1
    cutoff_hz: float = 300.0
    threshold: str = "dynamic"  # dynamic (by block), fixed (one for all), channel (chan_uv, see with_channel_thresholds)
    chan_uv: tuple[tuple[int, float], ...] = ()
    noise: str = "median"
    noise_mult: float = 4.5
    fixed_uv: float = 40.0
    pp_mult: float = 1.5
    dt_us: float = 600.0
    window_us: tuple[float, float] = (-500.0, 1000.0)
    lock_factor: float = 3.0
    include_um: float = 100.0
    locator: str = "gaussian 1d"
    most_sigma: float = 200.0


def preprocess(data: np.ndarray, rate_hz: float, s: Settings) -> np.ndarray:
    """Filter, common average reference, resample: in this order."""
    x = np.nan_to_num(np.asarray(data, float))  # a missing sample is zero
    if s.filter == "wavelet":
        x = filters.wavelet_highpass(x)
    elif s.filter:
        b, a = filters.butterworth(4, s.cutoff_hz, rate_hz, "highpass")
        x = filters.filtfilt(b, a, x) if s.filter == "butter-zero-phase" else filters.lfilter(b, a, x)[0]
    if s.car:
        x = x - (np.median(x, axis=0) if s.car == "median" else x.mean(axis=0))
    return filters.resample(x, s.resample) if s.resample > 1 else x


def block_thresholds(x: np.ndarray, s: Settings, chans=None) -> tuple[np.ndarray, np.ndarray]:
    """Peak and peak-to-peak thresholds per channel."""
    if s.threshold == "fixed":
        th = np.full(len(x), s.fixed_uv)
    elif s.threshold == "channel":
        known = dict(s.chan_uv)
        if missing := sorted({int(c) for c in chans} - set(known)):
            raise ValueError(f"channels {missing} have no threshold")
        th = np.array([known[int(c)] for c in chans])
    else:
        level = filters.lower_median(np.abs(x)) / 0.6745 if s.noise == "median" else x.std(axis=1)
        th = np.maximum(np.rint(level * s.noise_mult), s.fixed_uv)
    return th, np.rint(th * s.pp_mult)


class BlockSearch:
    """Greedy scan over the threshold peaks of one block, with lockouts per channel (D3)."""

    def __init__(self, x: np.ndarray, tres_us: float, xs: np.ndarray, ys: np.ndarray, s: Settings, cut: tuple[int, int], chans=None):
        self.x, self.s, self.cut = x, s, cut
        self.xs, self.ys = np.asarray(xs, float), np.asarray(ys, float)
        self.dist = np.hypot(self.xs[:, None] - self.xs, self.ys[:, None] - self.ys)
        self.sharp = filters.sharpness(x)
        self.peaks = [np.flatnonzero(r) for r in self.sharp]
        self.dti = max(1, int(s.dt_us / tres_us))
        self.twi = (int(np.rint(s.window_us[0] / tres_us)), int(np.rint(s.window_us[1] / tres_us)))
        self.th, self.ppth = block_thresholds(x, s, chans)
        self.lock = np.full(len(x), -1)

    def run(self) -> Iterator[dict]:
        hits = np.argwhere((self.sharp != 0).T & (np.abs(self.x) >= self.th[:, None]).T)
        coming = {(int(t), int(c)) for t, c in hits}
        for t, c in hits.tolist():
            coming.discard((t, c))
            if t <= self.lock[c]:
                continue
            spike = self._judge(t, c, coming)
            if spike:
                yield spike

    def _pair(self, c: int, t: int, reach: int) -> tuple[int, int | None, float] | None:
        """Sharpest unlocked peak of a channel near t, its opposite neighbour, and their sharpness difference."""
        p = self.peaks[c]
        near = p[(p >= t - reach) & (p <= t + reach) & (p > self.lock[c])]
        if not len(near):
            return None
        k = int(near[np.argmax(np.abs(self.sharp[c, near]))])
        sign = np.sign(self.sharp[c, k])
        adj = [int(q) for q in near if np.sign(self.sharp[c, q]) == -sign]
        i = int(np.searchsorted(p, k))
        adj = [q for q in adj if q in (p[i - 1] if i else -1, p[i + 1] if i + 1 < len(p) else -1)]
        if not adj:
            return k, None, float(self.sharp[c, k])
        o = max(adj, key=lambda q: (abs(self.sharp[c, q]), -q))
        return k, o, float(self.sharp[c, k] - self.sharp[c, o])

    def _judge(self, t: int, c: int, coming: set) -> dict | None:
        s = self.s
        near = np.flatnonzero(self.dist[c] <= s.include_um)
        # other channels are searched half as far
        found = {int(n): r for n in near if (r := self._pair(int(n), t, self.dti if n == c else self.dti // 2))}
        if c not in found:
            return None
        if found[c][1] is None and abs(found[c][2]) < self.ppth[c] ** 2 / self.dti:
            return None
        top = max(sorted(found), key=lambda n: abs(found[n][2]))
        k, o, _ = found[top]
        if (k, top) != (t, c) and (k, top) in coming and (top != c or k > t):
            return None  # the better peak gets its own turn
        if k <= self.lock[top] or not self.cut[0] <= k < self.cut[1]:
            return None
        v = self.x[top, k]
        w = self.x[top, o] if o is not None else 0.0
        if max(abs(v), abs(w)) < self.th[top] or (abs(v - w) if o is not None else abs(v)) < self.ppth[top] * (o is not None):
            return None
        pair = sorted({k, o if o is not None else k})
        align = min(pair, key=lambda q: (self.x[top, q], q))
        a, b = max(0, align + self.twi[0]), min(self.x.shape[1], align + self.twi[1])
        weights = fits.peak_weights(self.x[near], k, o)
        fit = fits.LOCATORS[s.locator](weights, self.xs[near], self.ys[near], s.most_sigma)
        if fit is None:
            return None
        x0, y0, sx, sy = fit
        home = self.dist[top] <= min(s.lock_factor * sx, s.include_um)
        self.lock[home] = np.maximum(self.lock[home], pair[-1])
        return {"ti": align, "chan": top, "chans": near.tolist(), "lockchans": np.flatnonzero(home).tolist(), "ti0": a, "ti1": b,
                "V0": float(self.x[top, pair[0]]), "V1": float(self.x[top, pair[-1]]), "Vpp": float(abs(v - w)), "dt": pair[-1] - pair[0],
                "x0": x0, "y0": y0, "sx": sx, "sy": sy, "wave": self.x[near, a:b].tolist()}


SPIKES = "rec string, block long, t long, t0 long, t1 long, dt int, chan int, chans array<int>, lockchans array<int>, V0 double, V1 double, Vpp double, x0 double, y0 double, sx double, sy double, wave array<array<double>>"


def detect(frames: DataFrame, probe: dict[int, tuple[float, float]], settings: Settings | None = None) -> DataFrame:
    """Spikes of all blocks (D1-D6). The probe has at most a few hundred sites and travels with the function."""
    s = settings or Settings()
    names = [c.split()[0] for c in SPIKES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f in pdf.itertuples(index=False):
                chans = np.asarray(f.chans)
                raw = np.stack([np.asarray(r, float) for r in f.data])
                x = preprocess(raw, 1e6 / f.tres_us, s)
                tres = f.tres_us / s.resample
                xs, ys = np.array([probe[int(c)] for c in chans], float).T
                cut = tuple(int(np.ceil((c - f.t0_us) / tres)) for c in (f.cut0_us, f.cut1_us))
                at = lambda k: int(np.rint(f.t0_us + k * tres))  # noqa: B023, E731
                for p in BlockSearch(x, tres, xs, ys, s, cut, chans).run():
                    rows.append((f.rec, f.block, at(p["ti"]), at(p["ti0"]), at(p["ti1"]), int(np.rint(p["dt"] * tres)), int(chans[p["chan"]]),
                                 chans[p["chans"]].tolist(), chans[p["lockchans"]].tolist(), *[p[k] for k in ("V0", "V1", "Vpp", "x0", "y0", "sx", "sy", "wave")]))
            yield pd.DataFrame(rows, columns=names)

    return frames.mapInPandas(run, SPIKES)


def with_channel_thresholds(frames: DataFrame, settings: Settings, noise_s: float = 10.0, seed: int = 0) -> Settings:
    """Settings with a fixed threshold per channel, from the noise of random blocks (A5).

    Blocks are drawn without replacement, in the order of a hash of their
    number and ``seed``, until they own ``noise_s`` seconds; all blocks if there
    are no more.  Their samples are preprocessed as for detection, and the
    noise is the median of |v| / 0.6745 or the standard deviation over all of
    them, an aggregate per channel.
    """
    length = F.col("cut1_us") - F.col("cut0_us")
    drawn = frames.select("rec", "block", length.alias("us"), F.xxhash64("rec", "block", F.lit(seed)).alias("h"))
    widest = drawn.agg(F.max("us")).first()[0]
    if widest is None:
        raise ValueError("there are no blocks to take the noise from")
    some = drawn.orderBy("h", "rec", "block").limit(max(1, round(noise_s * 1e6 / widest))).select("rec", "block")
    mine = frames.join(F.broadcast(some), ["rec", "block"])  # noise_s seconds of blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                x = preprocess(np.stack([np.asarray(r, float) for r in f.data]), 1e6 / f.tres_us, settings)
                tres = f.tres_us / settings.resample
                lo, hi = (int(np.ceil((c - f.t0_us) / tres)) for c in (f.cut0_us, f.cut1_us))
                x = x[:, max(0, lo) : hi]
                yield pd.DataFrame({"chan": np.repeat(np.asarray(f.chans, np.int32), x.shape[1]), "v": x.ravel()})

    rows = mine.mapInPandas(run, "chan int, v double")
    level = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(v))") / 0.6745 if settings.noise == "median" else F.stddev_pop("v")
    noise = rows.groupBy("chan").agg(level.alias("noise")).collect()  # a row per channel
    limits = tuple(sorted((r.chan, float(max(np.rint(r.noise * settings.noise_mult), settings.fixed_uv))) for r in noise))
    return replace(settings, threshold="channel", chan_uv=limits)


def with_ids(spikes: DataFrame) -> DataFrame:
    """Ids in (t, chan) order within each recording."""
    w = Window.partitionBy("rec").orderBy("t", "chan")
    return spikes.withColumn("id", (F.row_number().over(w) - 1).cast("long"))


def frames_from_samples(samples: DataFrame, tres_us: float, block_us: int, halo_us: int) -> DataFrame:
    """Frames from long samples ``(rec, chan, ti, v)``: every sample goes to the block that owns it and to neighbours whose halo it lies in.

    All channels of a frame cover the same samples, from the first to the last
    that any of them has; a sample that a channel lacks is NaN in its place.
    """
    t = F.rint(F.col("ti") * tres_us).cast("long")
    rows = samples.withColumn("_t", t).withColumn("block", F.explode(F.sequence(F.greatest(F.floor((t - halo_us) / block_us), F.lit(0)), F.floor((t + halo_us) / block_us))))
    line = rows.groupBy("rec", "block", "chan").agg(F.array_sort(F.collect_list(F.struct(F.col("ti").cast("long").alias("ti"), F.col("v").cast("double").alias("v")))).alias("_s"), F.min(F.col("ti").cast("long")).alias("_a"))
    f = line.groupBy("rec", "block").agg(F.array_sort(F.collect_list(F.struct("chan", "_s"))).alias("_c"), F.min("_a").alias("_a"), F.max(F.expr("_s[size(_s) - 1].ti")).alias("_z"))
    f = f.filter(F.col("_z") * tres_us >= F.col("block") * block_us).withColumn("_grid", F.sequence("_a", "_z"))

    def dense(s):
        lacking = F.array_except(F.col("_grid"), F.transform(s, lambda x: x["ti"]))
        return F.array_sort(F.concat(s, F.transform(lacking, lambda t: F.struct(t.alias("ti"), F.lit(float("nan")).alias("v")))))

    return f.select(
        "rec", "block", (F.col("_a") * tres_us).alias("t0_us"), F.lit(float(tres_us)).alias("tres_us"),
        (F.col("block") * block_us).cast("double").alias("cut0_us"), ((F.col("block") + 1) * block_us).cast("double").alias("cut1_us"),
        F.transform("_c", lambda c: c["chan"].cast("int")).alias("chans"), F.transform("_c", lambda c: F.transform(dense(c["_s"]), lambda s: s["v"])).alias("data"),
    )


def relocate(spikes: DataFrame, probe: dict[int, tuple[float, float]], locator: str = "gaussian 1d", most_sigma: float = 200.0) -> DataFrame:
    """Fit positions anew from stored waves; rejected fits get sigma 0 and keep their centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for f in pdf.itertuples(index=False):
                w = np.ptp(np.stack([np.asarray(r, float) for r in f.wave]), axis=1)
                xs, ys = np.array([probe[int(c)] for c in f.chans], float).T
                got.append(fits.LOCATORS[locator](w, xs, ys, most_sigma) or (*fits.spatial_mean(w, xs, ys), 0.0, 0.0))
            for k, c in enumerate(("x0", "y0", "sx", "sy")):
                pdf[c] = [g[k] for g in got]
            yield pdf

    return spikes.mapInPandas(run, spikes.schema)


def align_spikes(waves: DataFrame, unit: str = "nid", most: int = 2) -> DataFrame:
    """Best shift of each wave towards its unit's mean.

    The mean is an aggregate over all members; the shifts are then found row by
    row, so a unit of any size is spread over tasks.
    """
    flat = waves.select(unit, "sid", F.posexplode("wave").alias("c", "_w")).select(unit, "c", F.posexplode("_w").alias("k", "v"))
    mean = flat.groupBy(unit, "c", "k").agg(F.avg("v").alias("m"))
    mean = mean.groupBy(unit, "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("m"))
    mean = mean.groupBy(unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "m"))), lambda s: s["m"]).alias("_mean"))

    def best(wave: pd.Series, mean: pd.Series) -> pd.Series:
        out = []
        for w, m in zip(wave, mean, strict=True):
            w, m = (np.stack([np.asarray(r, float) for r in a]) for a in (w, m))
            cost = [((fits.shift_wave(w, k) - m) ** 2).sum() for k in range(-most, most + 1)]
            out.append(int(np.argmin(cost)) - most)
        return pd.Series(out, dtype="int32")

    return waves.join(mean, unit).withColumn("shift", F.pandas_udf(best, "int")("wave", "_mean")).drop("_mean")
