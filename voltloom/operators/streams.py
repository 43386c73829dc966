"""Streams over a recording or a track: settings, slices on the sample grid, channels, descriptors.

A stream is its settings and the plan they stand for; changing a setting makes
another stream, so nothing has to be invalidated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from .signal import car
from .spikes import frames_from_samples

HIGHPASS_RATE_FACTOR = 2
LOWPASS_RATE = 1000.0
HIGHPASS_CUTOFF = 300.0
LOWPASS_CUTOFF = 110.0
ORDER = {"highpass": 4, "lowpass": 4}
#: butter is causal for highpass streams and without phase shift for lowpass ones.
FILTERS = {"highpass": (None, "butter", "butter-zero-phase", "wavelet"), "lowpass": (None, "butter")}


@dataclass(frozen=True)
class Stream:
    """Settings of a stream over samples (chan, ti, v) of ``rate`` (N1); ``chans`` None stands for every channel that the samples have."""

    kind: str  # highpass, lowpass
    raw_rate: float
    rate: float
    filter: str | None
    car: str | None
    cutoff_hz: float
    shcorrect: bool
    chans: tuple[int, ...] | None

    @classmethod
    def highpass(cls, raw_rate: float, chans=None, **how) -> Stream:
        """Twice the raw rate, Butterworth highpass, common median reference."""
        return cls("highpass", raw_rate, HIGHPASS_RATE_FACTOR * raw_rate, "butter", "median", HIGHPASS_CUTOFF, False, _ordered(chans)).with_settings(**how)

    @classmethod
    def lowpass(cls, raw_rate: float, chans=None, **how) -> Stream:
        """1 kHz, which must divide the raw rate; no reference."""
        out = cls("lowpass", raw_rate, LOWPASS_RATE, "butter", None, LOWPASS_CUTOFF, False, _ordered(chans)).with_settings(**how)
        if out.raw_rate % out.rate:
            raise ValueError(f"{out.rate} Hz does not divide {out.raw_rate} Hz")
        return out

    def with_settings(self, **how) -> Stream:
        """The stream under other settings."""
        return replace(self, **how)

    @property
    def is_raw(self) -> bool:
        """No filter, reference, resampling or sample-and-hold correction."""
        return self.filter is None and self.car is None and self.rate == self.raw_rate and not self.shcorrect

    def describe(self) -> dict:
        """What was done to the samples, for a sidecar."""
        band = {"highpass": ("f0_hz", None), "lowpass": (None, "f1_hz")}[self.kind]
        return {"filter": self.filter, **{k: self.cutoff_hz if self.filter else None for k in band if k}, "car": self.car, "sample_rate": self.rate, "shcorrect": self.shcorrect}

    def enable(self, chans) -> Stream:
        """Only these channels are read and referenced from now on."""
        self._known(chans)
        return replace(self, chans=_ordered(chans))

    def _known(self, chans) -> None:
        if self.chans is not None and (missing := sorted(set(chans) - set(self.chans))):
            raise ValueError(f"no channels {missing}")

    @property
    def tres_us(self) -> float:
        return 1e6 / self.rate

    def on_grid(self, t_us: float, percent: float = 50.0) -> int:
        """Sample number of a time; raises if it lies further than ``percent`` of a sample off the grid."""
        at = t_us / self.tres_us
        if abs(at - round(at)) * 100 > percent:
            raise ValueError(f"{t_us} us is off the sample grid")
        return round(at)

    def referenced(self, samples: DataFrame) -> DataFrame:
        """Enabled channels less their mean or median at each moment of a recording (T4)."""
        rows = samples.filter(_among(self.chans))
        if self.car is None:
            return rows
        by = [c for c in ("rec", "ti") if c in samples.columns]
        return car(rows, by, "v", self.car).withColumn("v", F.col("car")).drop("car")

    def process(self, x: np.ndarray, chans: np.ndarray) -> np.ndarray:
        """Samples of an unbroken run (channels x samples) filtered, referenced and resampled, in this order."""
        if self.filter == "wavelet":
            x = filters.wavelet_highpass(x)
        elif self.filter:
            b, a = filters.butterworth(ORDER[self.kind], self.cutoff_hz, self.raw_rate, self.kind)
            causal = self.kind == "highpass" and self.filter == "butter"
            x = filters.lfilter(b, a, x)[0] if causal else filters.filtfilt(b, a, x)
        if self.car and self.kind == "highpass":
            x = x - (np.median(x, axis=0) if self.car == "median" else x.mean(axis=0))
        up = self.factors[0]
        if up > 1 or self.shcorrect:
            x = filters.resample(x, up, delays=filters.sample_hold_delays(chans, self.raw_rate) if self.shcorrect else None)
        return x

    @property
    def factors(self) -> tuple[int, int]:
        """By how much the rate goes up, and down, from the raw one."""
        return (round(self.rate / self.raw_rate), 1) if self.kind == "highpass" else (1, round(self.raw_rate / self.rate))

    def _check(self) -> None:
        """Refuse settings that reading cannot apply."""
        if self.filter not in FILTERS[self.kind]:
            raise ValueError(f"a {self.kind} stream knows the filters {FILTERS[self.kind]}, not {self.filter!r}")
        if self.kind == "highpass" and (self.rate < self.raw_rate or self.rate % self.raw_rate):
            raise ValueError(f"{self.rate} Hz is no multiple of {self.raw_rate} Hz")
        if self.kind == "lowpass" and (self.raw_rate % self.rate or self.shcorrect or self.car):
            raise ValueError("a lowpass stream is decimated by a whole number and neither corrected nor referenced")
        if self.car not in (None, "median", "mean"):
            raise ValueError(f"unknown reference {self.car!r}")

    def read(self, samples: DataFrame, start_us: float, stop_us: float, chans=None, block_s: float = 10.0, halo: int = 200) -> DataFrame:
        """(chan, ti, v), and rec where samples have it, of [start, stop) at the stream's rate, cut to what there is.

        All that ``describe`` says is done: samples are put into blocks of
        ``block_s`` seconds with ``halo`` raw samples around them, and each
        unbroken run of moments is filtered, referenced over all enabled
        channels and resampled by itself, so no filter reaches over a gap; a
        channel that lacks a moment which others have is zero there.  Channels are chosen
        after the reference (P5).  A stream without filter and resampling stays
        in built-in expressions.
        """
        self._check()
        self._known(chans or ())
        a, b = self.on_grid(start_us), self.on_grid(stop_us)
        chosen = _among(chans if chans is not None else self.chans)
        if self.filter is None and self.rate == self.raw_rate and not self.shcorrect:
            return self.referenced(samples.filter((F.col("ti") >= a) & (F.col("ti") < b))).filter(chosen)
        up, down = self.factors
        first, last = a * down // up - halo, -(-b * down // up) + halo
        rows = samples.filter((F.col("ti") >= first) & (F.col("ti") < last) & _among(self.chans))
        named = "rec" in samples.columns
        rows = rows.select(F.col("rec").cast("string").alias("rec") if named else F.lit("").alias("rec"), "chan", "ti", "v")
        tres = 1e6 / self.raw_rate
        frames = frames_from_samples(rows, tres, max(1, round(block_s * self.raw_rate)) * tres, halo * tres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for f in batch.select(["rec", "t0_us", "cut0_us", "cut1_us", "chans", "data"]).to_pylist():
                    x, at = np.array(f["data"], float), round(f["t0_us"] / tres)
                    own = [-(-round(f[c] / tres) * up // down) for c in ("cut0_us", "cut1_us")]
                    for lo, hi in runs(~np.isnan(x).all(0)):
                        y = self.process(np.nan_to_num(x[:, lo:hi]), np.array(f["chans"]))
                        ti = (at + lo) * up + np.arange(y.shape[1])
                        keep = (ti % down == 0) & (ti // down >= own[0]) & (ti // down < own[1])
                        y, ti = y[:, keep], ti[keep] // down
                        n = y.size
                        cols = [pa.array([f["rec"]] * n, pa.string()), pa.array(np.repeat(np.array(f["chans"], np.int32), len(ti))), pa.array(np.tile(ti.astype(np.int64), len(y))), pa.array(y.ravel().astype(float))]
                        yield pa.record_batch(cols, names=["rec", "chan", "ti", "v"])

        out = frames.mapInArrow(run, "rec string, chan int, ti long, v double").filter((F.col("ti") >= a) & (F.col("ti") < b) & chosen)
        return out if named else out.drop("rec")


def _ordered(chans) -> tuple[int, ...] | None:
    return None if chans is None else tuple(sorted(chans))


def _among(chans) -> Column:
    """Whether a sample is of one of these channels."""
    return F.lit(True) if chans is None else F.col("chan").isin(sorted(chans))


def runs(present: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], present.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def same_for_all(streams: list[Stream], **how) -> list[Stream]:
    """One setting for every member of a track, which must agree in rate and channels."""
    if len({(s.kind, s.raw_rate, s.chans) for s in streams}) > 1:
        raise ValueError("members of a track differ in kind, rate or channels")
    return [s.with_settings(**how) for s in streams]


def clamp(start: Column, stop: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """A requested range cut to the limits of the file; empty at the nearer limit if it lies outside."""
    a = F.least(F.greatest(start, first), last)
    return a, F.least(F.greatest(stop, a), last)


def in_view(rows: DataFrame, t: str, centre: float, before: float, after: float) -> DataFrame:
    """Rows within [centre - before, centre + after)."""
    return rows.filter((F.col(t) >= centre - before) & (F.col(t) < centre + after))


def to_16_bit(v: Column, bits: int = 12) -> Column:
    """Samples of fewer bits moved up to 16 bits."""
    return F.shiftleft(v.cast("int"), 16 - bits).cast("short")
