"""Files written by many tasks, and arrays read by ranges."""

import json
import os
import struct

import numpy as np
import pytest

from voltloom.operators import streams
from voltloom.sources import arrays, events, exports, positional, recordings


def long_of(spark, x, first=0, chans=None, drop=()):
    chans = chans or list(range(len(x)))
    rows = [(c, first + t, float(x[k, t])) for k, c in enumerate(chans) for t in range(x.shape[1]) if (c, first + t) not in drop]
    return spark.createDataFrame(rows, "chan int, ti long, v double").repartition(7)


@pytest.mark.parametrize("block", [1, 64, 10_000])
def test_dat_equals_the_serial_writer(spark, tmp_path, block):
    x = np.random.default_rng(0).integers(-900, 900, (3, 70 if block == 1 else 1000)).astype(np.int16)
    a, b = str(tmp_path / "a.dat"), f"file://{tmp_path}/b.dat"
    recordings.write_dat(a, x, 25000.0, 0.5, "p", [9, 2, 5])
    n = exports.write_dat(long_of(spark, x * 0.5, 40, [9, 2, 5], drop={(2, 55)}), b, 25000.0, 0.5, "p", [9, 2, 5], block=block)
    want = np.frombuffer(open(a, "rb").read(), "<i2").reshape(-1, 3).copy()
    want[15, 1] = 0
    got = np.frombuffer(open(tmp_path / "b.dat", "rb").read(), "<i2").reshape(-1, 3)
    assert n == x.shape[1] and (got == want).all() and json.load(open(tmp_path / "b.dat.json"))["nsamples_offset"] == 40
    assert sorted(os.listdir(tmp_path)) == ["a.dat", "a.dat.json", "b.dat", "b.dat.json"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="int16"):
        exports.write_dat(long_of(spark, np.full((2, 50), 1e6)), str(tmp_path / "c.dat"), 25000.0, 1.0, "p")
    with pytest.raises(ValueError, match="bytes were written"):
        positional.write(spark.range(1), lambda b: iter([(0, b"abc")]), str(tmp_path / "d"), 10, whole=10)
    assert os.listdir(tmp_path) == []
    assert exports.write_dat(long_of(spark, np.zeros((1, 1))).limit(0), str(tmp_path / "e.dat"), 25000.0, 1.0, "p", [0]) == 0
    assert os.path.getsize(tmp_path / "e.dat") == 0


def test_objects_are_joined_in_order(spark, tmp_path, monkeypatch):
    """Stores without writes in the middle: pieces become objects of their own."""
    monkeypatch.setattr(positional.Target, "local", property(lambda self: None))
    target = positional.Target(str(tmp_path / "f"), "x")
    target.start(20)
    name = target.put(5, b"abc")
    assert open(name, "rb").read() == b"abc"
    target.abort()
    assert os.listdir(tmp_path) == []


def test_frames_go_out_without_a_shuffle(spark, tmp_path):
    x = np.random.default_rng(1).integers(-2000, 2000, (4, 5000)).astype(np.int16)
    a, b, c = (str(tmp_path / f"{k}.dat") for k in "abc")
    recordings.write_dat(a, x, 25000.0, 0.25, "p", [3, 1, 8, 6])
    frames = recordings.frames(spark, a, block_s=0.03, halo=300)
    assert exports.write_frames(frames, b, 25000.0, 0.25, "p", [1, 3, 6, 8]) == 5000
    got = np.frombuffer(open(b, "rb").read(), "<i2").reshape(-1, 4)
    assert (got == x[[1, 0, 3, 2]].T).all()
    s = streams.Stream.highpass(25000.0, [1, 3, 6, 8], filter="butter-zero-phase")
    n = exports.write_frames(frames, c, 50000.0, 0.25, "p", [1, 3, 6, 8], s)
    side = json.load(open(c + ".json"))
    got = np.frombuffer(open(c, "rb").read(), "<i2").reshape(-1, 4)
    assert n == 10_000 and side["filter"] == "butter-zero-phase" and side["sample_rate"] == 50000.0 and side["car"] == "median"
    long = recordings.samples(recordings.frames(spark, a, block_s=1, halo=0)).drop("rec")
    want = np.zeros((10_000, 4))
    for r in s.read(long, 0, 200_000, halo=300).collect():
        want[r.ti, [1, 3, 6, 8].index(r.chan)] = r.v / 0.25
    inner = slice(0, 9990)  # the last half sample has no successor to interpolate to
    assert np.abs(got[inner] - want[inner]).max() <= 40 and np.median(np.abs(got[inner] - want[inner])) <= 1


def plain_ptcs(spikes, units, t0, t1, text, rate):
    body, total, n = b"", 0, 0
    for nid, good, x0, y0 in sorted(units):
        ts = sorted(t - t0 for s, t, c, u in spikes if u == nid and t0 <= t < t1)
        if good and ts:
            chan = min(c for s, t, c, u in spikes if u == nid and t0 <= t < t1)
            body += struct.pack("<qQddddQQQQQQQ", nid, 0, 0.0, x0, y0, 0.0, 1, chan, 0, 8, 0, 0, len(ts)) + np.array(ts, "<i8").tobytes()
            total, n = total + 1, n + len(ts)
    text = events.pad8(text.encode())
    return struct.pack("<qQ", 3, len(text)) + text + struct.pack("<QQQQ", total, n, 8, rate) + body


def test_ptcs_by_places(spark, tmp_path):
    """A unit of most spikes is cut by partitions; bad, empty and unknown units stay out."""
    rng = np.random.default_rng(2)
    rows = [(k, int(t), int(rng.integers(0, 4)), int(u)) for k, (t, u) in enumerate(zip(rng.integers(0, 90_000, 3000), rng.choice([1, 2, 3, 7, 9], 3000, p=[0.8, 0.05, 0.05, 0.05, 0.05])))]
    units = [(1, True, 1.0, 2.0), (2, False, 0.0, 0.0), (3, True, 5.0, 6.0), (7, True, 7.0, 8.0), (11, True, 0.0, 0.0)]
    s = spark.createDataFrame(rows, "sid long, t long, chan int, nid long").repartition(5)
    u = spark.createDataFrame(units, "nid long, good boolean, x0 double, y0 double")
    out = str(tmp_path / "a.ptcs")
    assert events.write_ptcs(s, u, out, 1000, 80_000, "text", 25000) == 3
    assert open(out, "rb").read() == plain_ptcs(rows, units, 1000, 80_000, "text", 25000)
    assert events.write_ptcs(s.limit(0), u, out, 0, 10) == 0 and open(out, "rb").read() == plain_ptcs([], units, 0, 10, "", 25000)


# ---------------------------------------------------------------- arrays


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_by_ranges(spark, tmp_path, save):
    rng = np.random.default_rng(3)
    t, w, c = rng.uniform(0, 1e9, 1000), rng.integers(-99, 99, (1000, 3, 5)).astype(np.int16), rng.integers(0, 200, 1000).astype(np.uint8)
    p = str(tmp_path / "a.npz")
    save(p, t=t, w=w, c=c, scalar=7.5)
    have = arrays.catalog(p)
    assert {k: (a.shape, a.offset is None) for k, a in have.items()}["w"] == ((1000, 3, 5), save is not np.savez) and float(arrays.values(have["scalar"])) == 7.5
    df = arrays.rows(spark, {"t": (p, "t"), "w": (p, "w"), "c": (p, "c")}, rows_a_task=130)
    assert df.rdd.getNumPartitions() == (8 if save is np.savez else 1) and dict(df.dtypes) == {"row": "bigint", "t": "double", "w": "array<bigint>", "c": "bigint"}
    got = df.orderBy("row").collect()
    assert [r.row for r in got] == list(range(1000)) and np.array_equal([r.t for r in got], t) and np.array_equal([r.w for r in got], w.reshape(1000, 15)) and np.array_equal([r.c for r in got], c)
    with pytest.raises(Exception, match="lacks"):
        arrays.rows(spark, {"x": (p, "nothing")}).count()
    np.save(str(tmp_path / "b.npy"), t[:10])
    with pytest.raises(Exception, match="differ in length"):
        arrays.rows(spark, {"t": (p, "t"), "b": (str(tmp_path / "b.npy"), "data")}).count()
    np.savez(str(tmp_path / "o.npz"), o=np.array([{}], object))
    with pytest.raises(ValueError, match="are not read"):
        arrays.catalog(str(tmp_path / "o.npz"))


def test_imports_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(4)
    p, n = str(tmp_path / "e.events.zip"), 700
    t, chan, nid = np.sort(rng.integers(0, 1 << 40, n)), rng.integers(0, 54, n).astype(np.uint8), rng.integers(-3, 20, n).astype(np.int16)
    with open(p, "wb") as f:
        np.savez(f, spikets=t, maxchans=chan, nids=nid)
    got = events.events_zip(spark, p, 100).orderBy("sid").collect()
    assert [(r.t, r.chan, r.nid) for r in got] == list(zip(t.tolist(), chan.tolist(), nid.tolist()))
    w, m = rng.integers(-50, 50, (n, 4, 6)), rng.integers(1, 5, n)
    chans = np.sort(rng.permuted(np.tile(np.arange(10), (n, 1)), axis=1)[:, :4], axis=1)
    q = str(tmp_path / "w.eventwaves.zip")
    with open(q, "wb") as f:
        np.savez(f, wavedata=w, sampfreq=25000.0, uVperAD=0.5, chans=chans, nchans=m)
    for r in events.eventwaves_zip(spark, q, 90).collect():
        k = r.sid
        own = w[k, : m[k]]
        assert r.chans == chans[k, : m[k]].tolist() and r.wave == (own * 0.5).tolist() and r.t == round(k * 240) and r.chan == chans[k][np.ptp(own, axis=1).argmax()]
    for name, a in (("channel_map", np.arange(8) * 3), ("spike_times", np.arange(20)[:, None] * 5), ("spike_clusters", np.arange(20) % 3), ("templates", rng.normal(size=(3, 10, 8)))):
        np.save(str(tmp_path / f"{name}.npy"), a)
    top = np.abs(np.load(str(tmp_path / "templates.npy"))).max(1).argmax(1) * 3
    times = spark.createDataFrame([(k, k * 40.0) for k in range(0, 90, 5)], "ti long, t double")
    got = sorted(tuple(r) for r in events.kilosort(spark, str(tmp_path), times, 0.0, 6).collect())
    assert got == [(k, k * 200, int(top[k % 3]), k % 3 + 1) for k in range(18)]


def test_export_gate(spark, tmp_path):
    """Each fault of a unit stops the export, with its name; good units leave a file per recording."""
    s = [(k, 1000 * k + n, 0, n) for k in range(40) for n in (1, 2, 3)]
    u = spark.createDataFrame([(1, True, 0.0, 0.0), (2, True, 0.0, 0.0), (3, False, 0.0, 0.0)], "nid long, good boolean, x0 double, y0 double")
    shape = [0.0, 1.0, 4.0, -9.0, 5.0, 2.0, 1.0, 0.5]
    w = [(n, c, t, v * (2 - c)) for n in (1, 2) for c in (0, 1) for t, v in enumerate(shape)]
    g = [(1, 0, 3), (2, 0, 3)]
    frame = lambda s, w, g: (spark.createDataFrame(s, "sid long, t long, chan int, nid long"), u, spark.createDataFrame(w, "nid long, chan int, ti int, v double"), spark.createDataFrame(g, "nid long, chan int, at int"))
    exports.check_units(*frame(s, w, g))
    bad = [
        ("too short: units \\[2\\]", (s + [(900, 5 * 1000 + 2 + 10, 0, 2)], w, g)),
        ("off their trigger: units \\[1\\]", (s, w, [(1, 0, 7), (2, 0, 3)])),
        ("padded templates: units \\[1\\]", (s, [(n, c, t, 7.0 if n == 1 and c == 0 and t > 1 else v) for n, c, t, v in w], [(1, 0, 1), (2, 0, 3)])),
    ]
    for what, (a, b, c) in bad:
        with pytest.raises(ValueError, match=what):
            exports.check_units(*frame(a, b, c))
    lack = spark.createDataFrame([(1, True, 0.0, 0.0), (5, True, 0.0, 0.0)], u.schema)
    sp, _, wv, tr = frame(s, w, g)
    with pytest.raises(ValueError, match="left out after: units \\[1\\]"):
        exports.check_units(sp, lack, wv, tr)
    out = str(tmp_path / "out")
    assert exports.export_units(sp, u, [("a", 0, 20_000), ("b", 20_000, 60_000)], out, checked=(wv, tr)) == {"a": 2, "b": 2}
    rows = [tuple(r) for r in sp.collect()]
    assert open(out + "/b.ptcs", "rb").read() == plain_ptcs(rows, [tuple(r) for r in u.collect()], 20_000, 60_000, "b", 25000)


def test_channel_thresholds(spark, tmp_path):
    from voltloom.functions import filters
    from voltloom.operators import spikes

    rng = np.random.default_rng(7)
    x = np.rint(rng.normal(size=(3, 20_000)) * np.array([[10], [40], [90]])).astype(np.int16)
    x[1, 500::1000] -= 600
    x[1, 505::1000] += 600
    p = str(tmp_path / "n.dat")
    recordings.write_dat(p, x, 25000.0, 1.0, "p")
    frames = recordings.frames(spark, p, block_s=0.1, halo=100)
    plain = spikes.Settings(filter=None, car=None)
    every = spikes.with_channel_thresholds(frames, plain, noise_s=10)
    want = {c: max(np.rint(filters.lower_median(np.abs(x[c].astype(float))) / 0.6745 * 4.5), 40.0) for c in range(3)}
    assert every.threshold == "channel" and dict(every.chan_uv) == want
    some = spikes.with_channel_thresholds(frames, plain, noise_s=0.3)
    assert all(abs(v / want[c] - 1) < 0.15 for c, v in some.chan_uv) and some == spikes.with_channel_thresholds(frames, plain, noise_s=0.3)
    th, _ = spikes.block_thresholds(x[[2, 0]].astype(float), every, [2, 0])
    assert th.tolist() == [want[2], want[0]]
    with pytest.raises(ValueError, match="no threshold"):
        spikes.block_thresholds(x.astype(float), every, [0, 1, 9])
    probe = {0: (0.0, 0.0), 1: (0.0, 50.0), 2: (0.0, 100.0)}
    got = spikes.detect(frames, probe, every).toPandas()
    assert len(got) and all(max(abs(r.V0), abs(r.V1)) >= want[r.chan] for r in got.itertuples())
