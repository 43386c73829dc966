import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators import clustering, detection, relational, signal, spikes, units
from voltloom.sources import events, probes, recordings
from voltloom.streaming import windows


@pytest.fixture
def dat(tmp_path):
    rng = np.random.default_rng(0)
    x = rng.integers(-3000, 3000, (4, 2500)).astype(np.int16)
    path = str(tmp_path / "a.dat")
    recordings.write_dat(path, x, 1000.0, 0.5, "p")
    return path, x


def test_dat_round_trip(spark, dat):
    path, x = dat
    f = recordings.frames(spark, path, block_s=1, halo=20)
    assert f.count() == 3
    got = recordings.samples(f).toPandas()
    assert len(got) == x.size
    back = got.pivot(index="chan", columns="ti", values="v").to_numpy()
    assert np.array_equal(back, x * 0.5)


def test_dat_checks(tmp_path):
    path = str(tmp_path / "b.dat")
    recordings.write_dat(path, np.zeros((3, 5), np.int16), 1000.0, 1.0, "p")
    open(path, "ab").write(b"x")
    with pytest.raises(ValueError, match="whole frames"):
        recordings.dat_layout(path)
    meta = json.load(open(path + ".json"))
    del meta["uV_per_AD"]
    json.dump(meta, open(path + ".json", "w"))
    with pytest.raises(ValueError, match="uV_per_AD"):
        recordings.dat_layout(path)


def test_nsx_layout(tmp_path):
    n, x = 3, np.arange(30, dtype="<i2").reshape(10, 3)
    size = 314 + 66 * n
    head = struct.pack("<8sBBI16s256sII", b"NEURALCD", 2, 3, size, b"", b"", 1, 30000) + bytes(16) + struct.pack("<I", n)
    chans = b"".join(struct.pack("<2sH16sBBhhhh16s", b"CC", k, f"chan{k}".encode() if k < 3 else b"x", 0, 0, -100, 100, -25, 25, b"uV") + bytes(20) for k in (1, 2, 3))
    chans = b"".join(c.ljust(66, b"\0") for c in [chans[k * 66 : k * 66 + 66] for k in range(n)])
    path = str(tmp_path / "a.ns6")
    open(path, "wb").write(head + chans + struct.pack("<BII", 1, 0, 10) + x.tobytes())
    lay = recordings.nsx_layout(path)
    assert (lay.nchans, lay.nsamples, lay.rate, lay.uv_per_ad, lay.chans, lay.aux) == (3, 10, 30000.0, 0.25, [1, 2], [3])


def test_track(tmp_path):
    p = str(tmp_path / "t.track")
    recordings.write_track(p, ["a.dat", "b.dat"], [3, 1])
    assert recordings.track(p) == (["a.dat", "b.dat"], [1, 3])


def test_spike_files(spark, tmp_path):
    p = str(tmp_path / "e.events.zip")
    np.savez(open(p, "wb"), spikets=np.array([5.0, 9.0]), maxchans=np.array([1, 2], np.uint8), nids=np.array([1, 1], np.int16))
    s = events.events_zip(spark, p)
    assert [tuple(r) for r in s.orderBy("sid").collect()] == [(0, 5, 1, 1), (1, 9, 2, 1)]
    u = spark.createDataFrame([(1, True, 0.0, 5.0)], "nid long, good boolean, x0 double, y0 double")
    out = str(tmp_path / "x.ptcs")
    assert events.write_ptcs(s, u, out, 4, 100, "d") == 1
    raw = open(out, "rb").read()
    assert struct.unpack("<q", raw[:8])[0] == 3 and len(raw) % 8 == 0
    assert [tuple(r) for r in events.csv_rows(s, u).collect()] == [("0.000005", 1, 1), ("0.000009", 1, 2)]
    w = str(tmp_path / "w.eventwaves.zip")
    np.savez(open(w, "wb"), sampfreq=25000, uVperAD=2.0, wavedata=np.arange(12).reshape(1, 2, 6))
    r = events.eventwaves_zip(spark, w).first()
    assert r["wave"][1][0] == 12.0 and r["chans"] == [0, 1]


def test_sessions_and_updates(spark, tmp_path):
    s = spark.createDataFrame([(1, 5, 7), (2, 6, 7)], "sid long, t long, nid long")
    a = spark.createDataFrame([(1, 3)], "sid long, nid long")
    events.save_session({"spikes": s, "assignments": a}, str(tmp_path / "p"))
    got = events.load_session(spark, str(tmp_path / "p"), ["spikes", "assignments"])["spikes"]
    assert {(r.sid, r.nid) for r in got.collect()} == {(1, 3), (2, 0)}
    again = events.load_session(spark, str(tmp_path / "p"), ["spikes"])["spikes"]
    events.save_session({"spikes": again.withColumn("t", again.t + 1)}, str(tmp_path / "p"))  # from what is being replaced
    with pytest.raises(Exception, match="no session"):
        events.save_session({"assignments": a.select(F.raise_error(F.lit("no session")).alias("sid"))}, str(tmp_path / "p"))
    got = events.load_session(spark, str(tmp_path / "p"), ["spikes", "assignments"])
    assert {(r.sid, r.t) for r in got["spikes"].collect()} == {(1, 6), (2, 7)} and got["assignments"].count() == 1
    assert sum(x.name.startswith("spikes-") for x in (tmp_path / "p").iterdir()) == 1
    new = spark.createDataFrame([(2, 9, 1)], s.schema)
    assert {(r.sid, r.t) for r in events.update_rows(s, new, "sid").collect()} == {(1, 5), (2, 9)}
    old = spark.createDataFrame([(1, 2, 3, [1])], "phasetis int, dphase int, cid int, chans array<int>")
    assert set(events.migrate(old, "0.5").columns) == {"tis", "dt", "chans", "lockchans", "nlockchans", "tres", "user", "notes"}
    with pytest.raises(ValueError):
        events.migrate(old, "0.2")


def test_probes(spark):
    p = probes.frame(spark, probes.linear("l", 4, 50.0) + probes.columns("c", [2, 2], 40.0, 30.0))
    got = {r.probe: (r.nchans, r.ncols, r.nrows, r.ysep) for r in probes.summary(p).collect()}
    assert got == {"l": (4, 1, 4, 50.0), "c": (4, 2, 2, 40.0)}
    two = probes.shanks(p.filter("probe = 'l'"), [(0, 0), (200, 0)])
    assert sorted(r.chan for r in two.collect()) == list(range(8))
    assert [r.probe for r in probes.match_sites(p, p.filter("probe = 'c'").select("chan", "x", "y")).collect()] == ["c"]
    first = probes.order_by_axes(p.filter("probe = 'c'"), ["x", "y"], [True, False]).orderBy("place").first()
    assert (first.x, first.y) == (0.0, 40.0)
    near = {r.chan: r.nbhd for r in detection.neighbourhoods(p.filter("probe = 'l'").drop("probe"), 60.0).collect()}
    assert near[1] == [0, 1, 2]


def test_detect_on_frames(spark, tmp_path):
    from test_kernels import synthetic

    x, xs, ys, times, _ = synthetic(np.random.default_rng(5))
    path = str(tmp_path / "s.dat")
    recordings.write_dat(path, np.rint(x).astype(np.int16), 30000.0, 1.0, "l")
    probe = {k: (float(a), float(b)) for k, (a, b) in enumerate(zip(xs, ys))}
    cfg = spikes.Settings(filter=None, car=None)
    runs = []
    for block in (0.25, 0.5):
        s = spikes.with_ids(spikes.detect(recordings.frames(spark, path, block_s=block, halo=600), probe, cfg)).toPandas()
        runs.append(set(zip(s["t"], s["chan"])))
        found = np.rint(np.array(s["t"]) * 0.03)
        assert all(np.abs(found - t).min() <= 3 for t in times)
    assert len(runs[0] ^ runs[1]) <= 0.1 * len(runs[0])
    again = spikes.relocate(spikes.detect(recordings.frames(spark, path, block_s=0.5), probe, cfg), probe)
    assert again.count() > 0


def test_pipeline_kernels(spark):
    rows = [(0, k, [float(np.sin(k + j)), float(k % 3), float(j)]) for k in range(40) for j in [k % 5]]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>")
    pc = clustering.pca(df, "v", 2).toPandas()
    x = np.stack(pc["v"].to_numpy())
    w = np.linalg.svd(x - x.mean(0), full_matrices=False)[1]
    assert pc["pc0"].var(ddof=0) == pytest.approx(w[0] ** 2 / 40) and abs(pc["pc0"].mean()) < 1e-9
    assert clustering.components(df, ["g"], "id", "v", "nmf", 2).count() == 40
    pts = df.select("g", "id", *[df.v[k].alias(f"d{k}") for k in range(3)])
    assert clustering.cluster(pts, ["g"], "id", ["d0", "d1", "d2"]).count() == 40
    waves = spark.createDataFrame([(1, 1, [[0.0, 5.0, 0.0, 0.0]]), (1, 2, [[0.0, 0.0, 5.0, 0.0]]), (1, 3, [[0.0, 5.0, 0.0, 0.0]])], "nid long, sid long, wave array<array<double>>")
    assert {r.sid: r["shift"] for r in spikes.align_spikes(waves).collect()}[2] == -1
    long = spark.createDataFrame([("r", 0, t, float(t)) for t in range(100)], "rec string, chan int, ti long, v double")
    f = spikes.frames_from_samples(long, 10.0, 500, 50)
    assert f.count() == 2 and sorted(len(r.data[0]) for r in f.collect()) == [55, 55]


def test_edges(spark):
    empty = spark.createDataFrame([], "k int, lo long, hi long")
    assert relational.merge_intervals(empty, ["k"]).count() == 0
    iv = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 1, 2)], empty.schema)
    assert sorted((r.lo, r.hi) for r in relational.merge_intervals(iv, ["k"]).collect()) == [(0, 7), (9, 9)]
    d = spark.createDataFrame([(1, 0, 1.0), (1, 3, 2.0)], "k int, ti long, v double")
    assert [r.v for r in signal.gap_fill(d, ["k"]).orderBy("ti").collect()] == [1.0, 0.0, 0.0, 2.0]
    tree = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 5)], "node long, parent long")
    assert {r.node: r.parent for r in units.propagate(tree).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    cur = spark.createDataFrame([(1, -1), (2, -2)], "sid long, nid long")
    assert {r.nid for r in units.merge_units(cur, [-1, -2]).collect()} == {1}


def test_streaming(spark, tmp_path):
    rows = [(c, t, 50.0 if t in (3, 4, 20) else 0.0) for c in (0, 1) for t in range(30)]
    df = spark.createDataFrame(rows, "chan long, ti long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.lockout_peaks(stream, 40.0, 5).writeStream.format("memory").queryName("peaks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.chan, r.ti) for r in spark.sql("SELECT * FROM peaks").collect()) == [(0, 3), (0, 20), (1, 3), (1, 20)]
