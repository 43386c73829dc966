"""Sidecars, auxiliary channels, ground truth and level-5 .mat files."""

import json
import struct
import zlib

import numpy as np
import pytest

from voltloom.sources import arrays, exports, matfiles, recordings


def tsf_1002(path, x, truth=()):
    n, nt = x.shape
    raw = b"Test spike file " + struct.pack("<iiiif", 1002, 25000, n, nt, 2.0)
    for k in range(n):
        raw += struct.pack("<hhi", 10 * k, -k, n - k)
    raw += x.astype("<i2").tobytes() + struct.pack("<i", len(truth))
    raw += b"".join(np.array([t[k] for t in truth], "<i4").tobytes() for k in range(3))
    open(path, "wb").write(raw)


def tsf_1000(path, x, truth=None):
    n, nt = x.shape
    raw = b"Test spike file " + struct.pack("<i", 1000) + np.arange(2 * n, dtype="<i2").tobytes()
    raw += struct.pack("<ii64HHii", 25000, 1_000_000, *[500] * 64, 10, n, nt) + x.astype("<i2").tobytes()
    if truth is not None:
        raw += struct.pack("<ii", 65, len(truth)) + b"".join(np.array([t[k] for t in truth], "<u4").tobytes() for k in range(3))
    open(path, "wb").write(raw)


TRUTH = [(90, 7, 2), (10, 3, 1), (55, 7, 3)]


def test_tsf(spark, tmp_path):
    rng = np.random.default_rng(0)
    for version, n, write in ((1002, 4, tsf_1002), (1000, 54, tsf_1000)):
        p, x = str(tmp_path / f"{version}.tsf"), rng.integers(-2000, 2000, (n, 100))
        write(p, x, TRUTH)
        lay = recordings.layout(p)
        assert (lay.nchans, lay.nsamples, lay.rate, lay.extra["version"]) == (n, 100, 25000.0, version)
        assert lay.uv_per_ad == pytest.approx(1e7 / (2**15 * 2.0) if version == 1002 else 1e7 / (2**11 * 5000))
        assert lay.extra["sites"][1] == ([10, -1] if version == 1002 else [2, 3])
        got = {(r.chan, r.ti): r.v for r in recordings.samples(recordings.frames(spark, p, block_s=0.001, halo=3)).collect()}
        assert got == {(c, t): pytest.approx(x[c, t] * lay.uv_per_ad) for c in range(n) for t in range(100)}
        assert [tuple(r) for r in recordings.tsf_truth(spark, p).collect()] == [(1, 10, 3, 0), (2, 55, 7, 2), (0, 90, 7, 1)]
    tsf_1000(p, x)
    assert recordings.layout(p).extra["truth"] is None and recordings.tsf_truth(spark, p).count() == 0
    tsf_1002(p, x[:2], [(1, 1, 0)])
    with pytest.raises(Exception, match="start at one"):
        recordings.tsf_truth(spark, p).collect()
    open(p, "ab").close()
    open(p, "r+b").truncate(200)
    with pytest.raises(ValueError, match="inside its samples"):
        recordings.layout(p)


def test_aux_channels(spark, tmp_path):
    p = str(tmp_path / "a.dat")
    x = np.arange(40).reshape(4, 10).astype(np.int16)
    recordings.write_dat(p, x, 1000.0, 1.0, "p", chans=[5, 3, 8])
    side = json.load(open(p + ".json")) | {"nchans": 4, "aux_chans": [11]}
    json.dump(side, open(p + ".json", "w"))
    both = {(r.chan, r.ti): r.v for r in recordings.samples(recordings.frames(spark, p, aux=True)).collect()}
    assert both == {(c, t): float(x[k, t]) for k, c in enumerate([5, 3, 8, 11]) for t in range(10)}
    assert {r.chan for r in recordings.samples(recordings.frames(spark, p)).select("chan").distinct().collect()} == {5, 3, 8}
    assert recordings.channel(recordings.layout(p), 11) == 3
    with pytest.raises(KeyError):
        recordings.channel(recordings.layout(p), "chan5")


def test_sidecars(tmp_path):
    p = str(tmp_path / "x.ns3")
    with pytest.raises(ValueError, match="neither"):
        recordings.nsx_sidecar(p, ["any.ns6.json"])
    json.dump({"chan_layout_name": "a1x32"}, open(tmp_path / "any.ns6.json", "w"))
    assert recordings.nsx_sidecar(p, ["other.ns6.json", "any.ns6.json"]) == {"probe": "a1x32", "adapter": None}
    json.dump({"probe_name": "b", "adapter_name": "c"}, open(tmp_path / "x.ns6.json", "w"))
    assert recordings.nsx_sidecar(p, ["any.ns6.json"]) == {"probe": "b", "adapter": "c"}
    json.dump({"probe_name": "b", "site": 1}, open(tmp_path / "x.ns6.json", "w"))
    with pytest.raises(ValueError, match="fields"):
        recordings.nsx_sidecar(p)


def cell(name, members):
    body = matfiles._written(6, struct.pack("<II", matfiles.CELL, 0)) + matfiles._written(5, np.array([1, len(members)], "<i4").tobytes()) + matfiles._written(1, name.encode())
    body += b"".join(matfiles.matrix("", np.asarray(m, float)) for m in members)
    return struct.pack("<II", matfiles.MATRIX, len(body)) + body


@pytest.mark.parametrize("packed", [False, True])
def test_mat_files(spark, tmp_path, packed):
    p, rng = str(tmp_path / "q.mat"), np.random.default_rng(1)
    data = rng.normal(size=70_000) * 0.1
    matfiles.write(p, {"data": data, "samplingInterval": np.array([[1 / 24]]), "startData": np.zeros((1, 1)), "flag": np.array([True, False])}, packed)
    extra = [cell("spike_times", [[30.0, 500.0, 69_999.0]]), cell("spike_class", [[1.0, 2.0, 1.0], [0.0] * 3])]
    # a small element, as other writers make: two bytes in the tag itself
    small = matfiles._written(6, struct.pack("<II", 8, 0)) + matfiles._written(5, np.array([1, 2], "<i4").tobytes()) + struct.pack("<HH4s", 1, 1, b"s") + struct.pack("<HHbb2x", 1, 2, 5, -5)
    extra.append(struct.pack("<II", matfiles.MATRIX, len(small)) + small)
    with open(p, "ab") as f:
        for e in extra:
            z = zlib.compress(e)
            f.write(struct.pack("<II", matfiles.PACKED, len(z)) + z if packed else e)
    have = matfiles.catalog(p)
    assert set(have) == {"data", "samplingInterval", "startData", "flag", "s"}
    assert np.array_equal(matfiles.values(have["data"]), data) and matfiles.values(have["flag"]).tolist() == [1, 0] and matfiles.values(have["s"]).tolist() == [5, -5]
    rows = arrays.rows(spark, {"x": (p, "data")}, 9000)
    assert rows.rdd.getNumPartitions() == (1 if packed else 8) and np.array_equal([r.x for r in rows.orderBy("row").collect()], data)
    samples, truth, rate = matfiles.simulated(spark, p)
    step = 1e7 / 2**15 / 2000
    got = np.array([r.v for r in samples.orderBy("ti").collect()])
    assert rate == 24_000 and np.allclose(got, np.rint(data * 1000 / step) * step)
    assert [tuple(r) for r in truth.collect()] == [(0, 30, 1), (1, 500, 2), (2, 69_999, 1)]
    matfiles.write(p, {"data": np.array([1e9]), "samplingInterval": np.array([[1 / 24]])}, packed)
    with open(p, "ab") as f:
        f.write(cell("spike_times", [[]]) + cell("spike_class", [[]]))
    with pytest.raises(Exception, match="16 bits"):
        matfiles.simulated(spark, p)[0].collect()
    open(p, "wb").write(b"x" * 200)
    with pytest.raises(ValueError, match="level-5"):
        matfiles.catalog(p)


def test_channel_map(tmp_path):
    dat = str(tmp_path / "r.dat")
    sites = [(4, 0.0, 10.0), (2, 50.0, 30.0), (7, 0.0, 0.0)]
    matfiles.write_channel_map(exports.channel_map_file(dat), sites, 25000.0)
    got = {k: matfiles.values(a).tolist() for k, a in matfiles.catalog(dat + ".chanmap.mat").items()}
    assert got == {"connected": [1, 1, 1], "chanMap": [1, 2, 3], "chanMap0ind": [0, 1, 2], "xcoords": [0, 50, 0], "ycoords": [20, 0, 30], "kcoords": [1, 1, 1], "fs": [25000]}
    assert f"'{dat}.chanmap.mat'" in exports.kilosort_config(dat, 3, 25000.0)
