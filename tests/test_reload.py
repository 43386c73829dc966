"""Windows cut from raw files against plain slices; streams that act on their settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_surf import continuous, digital, header, layout, message

from voltloom.functions import filters
from voltloom.operators import streams
from voltloom.sources import exports, recordings, reload, surf

RATE = 25000.0


@pytest.fixture()
def files(spark, tmp_path):
    """Three .dat files with a gap after the second, and their samples on one clock."""
    rng = np.random.default_rng(1)
    paths, starts, whole = [], [0, 5000, 14000], {}
    for k, (a, n) in enumerate(zip(starts, (5000, 6000, 4000))):
        x = rng.integers(-3000, 3000, (5, n)).astype(np.int16)
        paths.append(str(tmp_path / f"r{k}.dat"))
        recordings.write_dat(paths[-1], x, RATE, 0.5, "p", chans=[3, 1, 4, 7, 9])
        whole |= {(c, a + t): 0.5 * float(x[i, t]) for i, c in enumerate([3, 1, 4, 7, 9]) for t in range(n)}
    return paths, starts, whole


def plain(windows, whole):
    return {sid: [[whole.get((c, t), 0.0) for t in range(a, b)] for c in chans] for sid, a, b, chans in windows}


WINDOWS = "sid long, ti0 long, ti1 long, chans array<int>"


def test_windows_from_flat_files(spark, files):
    paths, starts, whole = files
    rng = np.random.default_rng(2)
    windows = [(k, int(a), int(a) + int(rng.integers(1, 60)), sorted(rng.choice([1, 3, 4, 7, 9], rng.integers(1, 5), replace=False).tolist())) for k, a in enumerate(rng.integers(-50, 18000, 400))]
    windows += [(1000, 4990, 5010, [1, 3]), (1001, 10990, 14010, [9]), (1002, 12000, 12040, [3]), (1003, 100, 120, [3, 55]), (1004, 100, 100, [3]), (1005, 4900, 5300, [4]), (1006, 30000, 30010, [1])]
    df = spark.createDataFrame(windows, WINDOWS)
    extents = reload.flat_extents(spark, paths, starts)
    got = {r.sid: r.wave for r in reload.reload(df.repartition(3), extents).collect()}
    want = plain(windows, whole)
    assert got.keys() == want.keys()
    for sid in want:
        assert got[sid] == want[sid], sid
    # reads share what lies close, and hardly more is read than was asked for
    found = reload.pieces(df, extents)
    plan = reload.read_plan(found).collect()
    union = set()
    for p in found.collect():
        union.update((p.path, b) for b in range(p.byte0, p.byte1, 10))
    assert sum(r.pieces for r in plan) == found.count() and len(plan) < found.count() / 2
    assert sum(r.byte1 - r.byte0 for r in plan) <= 1.2 * 10 * len(union) + 8 * 600


def test_reads_are_bounded():
    rows = [{"path": "a", "byte0": k * 100, "byte1": k * 100 + 150} for k in range(100)] + [{"path": "b", "byte0": 0, "byte1": 10}, {"path": "b", "byte0": 12, "byte1": 30}, {"path": "b", "byte0": 1000, "byte1": 1010}]
    got = list(reload.coalesced(iter(rows), 0.2, 1000))
    assert all(b - a <= 1000 for _, a, b, *_ in got) and sum(len(x[4]) for x in got) == len(rows)
    assert [(a, b, n, len(h)) for p, a, b, n, h in got if p == "b"] == [(0, 30, 28, 2), (1000, 1010, 10, 1)]


def test_windows_from_records(spark, tmp_path):
    """Records of several .srf files, channel after channel, with a gap between two of them."""
    rng = np.random.default_rng(3)
    paths, whole = [], {}
    for k, at in enumerate((0, 40_000)):
        body = layout(0, [0, 1, 2], b"high") + message(b"MS", 0, 40_000.0, b"Recording started") + digital(5, 9)
        for t in (at, at + 4000, at + 12_000):  # 100 samples of 40 us each
            x = rng.integers(-2000, 2000, (3, 100))
            body += continuous(b"PS", t, 0, x)
            whole |= {(c, t // 40 + i): 2.0 * x[c, i] for c in range(3) for i in range(100)}
        paths.append(str(tmp_path / f"f{k}.srf"))
        open(paths[-1], "wb").write(header() + body)
    extents = reload.record_extents(surf.record_index(spark, paths), RATE, 2.0)
    windows = [(k, a, a + 25, [2, 0] if k % 2 else [1]) for k, a in enumerate(range(0, 1400, 13))]
    got = {r.sid: r.wave for r in reload.reload(spark.createDataFrame(windows, WINDOWS), extents).collect()}
    assert got == plain(windows, whole)


def test_clicks(spark, files):
    paths, starts, whole = files
    spikes = spark.createDataFrame([(1, 3, [1, 3, 4]), (2, 1, [1, 3]), (3, 9, [9])], "sid long, chan int, chans array<int>")
    clicks = spark.createDataFrame([(1, 40_000, 40_200, None), (2, 80_000, 79_800, 3)], "sid long, t long, other long, chan int")
    got = {r.sid: r for r in reload.reclick(spikes, clicks, reload.flat_extents(spark, paths, starts), RATE).collect()}
    assert set(got) == {1, 2} and (got[1].aligni, got[2].aligni, got[1].dt, got[2].dt, got[2].chan) == (0, 1, 200, 200, 3)
    assert (got[1].V0, got[1].V1) == (whole[3, 1000], whole[3, 1005]) and got[1].Vpp == abs(got[1].V1 - got[1].V0)
    assert (got[2].V0, got[2].V1) == (whole[3, 1995], whole[3, 2000]) and (got[1].t0, got[1].t1) == (39_500, 41_000)
    bad = spark.createDataFrame([(1, 40_000, 40_200, 9)], "sid long, t long, other long, chan int")
    with pytest.raises(Exception, match="two peaks"):
        reload.reclick(spikes, bad, reload.flat_extents(spark, paths, starts), RATE).collect()


def test_imported_events(spark, files):
    paths, starts, whole = files
    near = spark.createDataFrame([(3, [1, 3, 4]), (9, [7, 9])], "chan int, chans array<int>")
    ev = spark.createDataFrame([(0, 50_000, 3, 5), (1, 199_990, 9, 6)], "sid long, t long, chan int, nid long")
    w = reload.event_windows(ev, near, RATE)
    got = {r.sid: r.wave for r in reload.reload(w, reload.flat_extents(spark, paths, starts)).collect()}
    rows = [(r.sid, r.ti0, r.ti1, r.chans) for r in w.collect()]
    assert got == plain(rows, whole) and len(got[0][0]) == 37


# ---------------------------------------------------------------- streams


def samples_of(spark, x, present, rec=False):
    rows = [(*(("r",) if rec else ()), c, t, float(x[c, t])) for c in range(len(x)) for t in range(x.shape[1]) if present[t]]
    return spark.createDataFrame(rows, ("rec string, " if rec else "") + "chan int, ti long, v double")


def grid(rows, chans, n):
    out = np.full((chans, n), np.nan)
    for r in rows:
        out[r.chan, r.ti] = r.v
    return out


@pytest.fixture(scope="module")
def noise(spark):
    x = np.random.default_rng(4).normal(size=(4, 3000)) * 50
    present = np.ones(3000, bool)
    present[1200:1230] = present[2000:2400] = False
    return x, present, samples_of(spark, x, present).cache()


def test_lowpass_stream_filters_and_decimates(noise):
    x, present, samples = noise
    s = streams.Stream.lowpass(RATE, range(4), filter="butter")
    got = grid(s.read(samples, 0, 120_000, block_s=0.02, halo=600).collect(), 4, 120)
    b, a = filters.butterworth(4, 110.0, RATE, "lowpass")
    want = np.full((4, 3000), np.nan)
    for lo, hi in streams.runs(present):
        want[:, lo:hi] = filters.filtfilt(b, a, x[:, lo:hi])
    want = want[:, ::25]
    assert (np.isnan(got) == np.isnan(want)).all()
    one = grid(s.read(samples, 0, 120_000, block_s=10, halo=600).collect(), 4, 120)
    assert np.allclose(one, want, equal_nan=True) and np.nanstd(got) < 0.2 * x.std()
    inner = np.nanmax(np.abs(got - want)) / np.nanstd(want)
    assert inner < 1  # block edges settle over the halo
    part = grid(s.read(samples, 30_000, 60_000, [2], halo=3000).collect(), 4, 120)
    assert np.isfinite(part).sum() == np.isfinite(want[2, 30:60]).sum() and np.isnan(part[[0, 1, 3]]).all()
    assert np.allclose(part[2, 30:60], want[2, 30:60], equal_nan=True, atol=1e-6)


def test_highpass_stream_references_and_resamples(spark, noise):
    x, present, _ = noise
    samples = samples_of(spark, x, present, rec=True)
    s = streams.Stream.highpass(RATE, range(4))
    got = s.read(samples, 0, 120_000, block_s=0.05, halo=400).collect()
    assert {r.rec for r in got} == {"r"}
    b, a = filters.butterworth(4, 300.0, RATE, "highpass")
    want = np.full((4, 6000), np.nan)
    for lo, hi in streams.runs(present):
        y = filters.lfilter(b, a, x[:, lo:hi])[0]
        y = filters.resample(y - np.median(y, axis=0), 2)
        want[:, 2 * lo : 2 * lo + y.shape[1]] = y
    out = grid(got, 4, 6000)
    assert (np.isnan(out) == np.isnan(want)).all() and np.nanmax(np.abs(out - want)) < 0.05
    corrected = s.with_settings(shcorrect=True, car=None, rate=RATE, filter=None)
    y = grid(corrected.read(samples, 0, 40_000, halo=200).collect(), 4, 1000)
    z = filters.resample(x[:, :1200], 1, delays=filters.sample_hold_delays(np.arange(4), RATE))
    assert np.allclose(y, z[:, :1000]) and not np.allclose(y[1], x[1, :1000])


def test_streams_refuse_what_they_cannot_do(noise):
    x, present, samples = noise
    for s in (streams.Stream.highpass(RATE, range(4), filter="chebyshev"), streams.Stream.highpass(RATE, range(4), rate=1.5 * RATE), streams.Stream.lowpass(RATE, range(4), car="mean"), streams.Stream.highpass(RATE, range(4), car="mode")):
        with pytest.raises(ValueError):
            s.read(samples, 0, 1000)


def test_envelope_keeps_to_runs(spark, noise):
    x, present, samples = noise
    got = {(r.chan, r.ti): r.v for r in exports.envelope(samples, RATE, to_rate=5000.0).collect()}
    b, a = filters.butterworth(4, 500.0, RATE, "lowpass")
    for lo, hi in streams.runs(present):
        want = filters.filtfilt(b, a, np.abs(x[:, lo:hi]))
        for t in range(-(-lo // 5) * 5, hi, 5):
            assert got[2, t] == pytest.approx(want[2, t - lo])
    assert len(got) == 4 * present[::5].sum()


def test_zeroed_ranges(spark, noise):
    x, present, samples = noise
    ranges = spark.createDataFrame([(10, 20), (15, 30), (100, 100), (2900, 9000)], "ti0 long, ti1 long")
    for few in (1000, 0):
        got = {(r.chan, r.ti): r.v for r in exports.without_ranges(samples, ranges, 2, broadcast_rows=few).collect()}
        zero = lambda t: 8 <= t < 32 or 98 <= t < 102 or t >= 2898
        assert len(got) == 4 * present.sum() and all(v == (0.0 if zero(t) else x[c, t]) for (c, t), v in got.items())
    assert samples.filter(F.col("v").isNull()).count() == 0
