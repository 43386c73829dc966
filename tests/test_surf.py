"""The .srf reader on a synthetic file, and the exports."""

import datetime
import json
import struct

import numpy as np
import pytest

from voltloom.sources import exports, surf


def layout(probe, chans, text, name=b"probe_x", rate=25000):
    n = len(chans)
    return surf.LAYOUT.pack(
        b"L", 0, 1, 0, 1_000_000, 100_000, 1, probe, b"S", n, 4, 100, 0, 0, 0, 0, 7, rate, *([10] * n + [0] * (64 - n)), 1, *(list(chans) + [0] * (64 - n)), text, name, 0, 0, 5, 5
    )


def continuous(tag, t, probe, data):
    x = (np.asarray(data) + 2048).astype("<i2").tobytes()
    raw = bytearray(surf.CONTINUOUS.pack(0, t, probe, 0, 0, len(x) // 2))
    raw[:2] = tag
    return bytes(raw) + x


def message(tag, t, days, text):
    return surf.MESSAGE.pack(tag[:1], tag[1:], t, days, len(text)) + text


def digital(t, v):
    raw = bytearray(surf.DIGITAL.pack(0, t, v, 0, 0))
    raw[:2] = b"VD"
    return bytes(raw)


def display(t, days, version, table=b""):
    n = surf.STIMULUS_NAME[version]
    body = surf.STIMULUS.pack(b"DS", version) + b"movie".ljust(n, b"\0") + struct.pack("<749f", *([0.5] * 748 + [float("nan")]))
    return surf.DISPLAY.pack(b"D", t, days) + body + table.ljust(surf.STIMULUS_TABLE[version], b" ") + surf.STIMULUS_SCREEN.pack(1, 2, 3, 4, 5, 6, 7, 8) + b"\0" * 4


def header():
    raw = bytearray(surf.HEADER_LEN)
    raw[0], raw[2:5], raw[2048] = 1, b"UFF", 1
    block = bytearray(surf.DESCRIPTOR_LEN)
    block[0] = 2
    return bytes(raw) + bytes(block) * 2


HIGH = [np.arange(12).reshape(3, 4) - 6, np.arange(12).reshape(3, 4) * 3]
DAYS = 40_000.25


@pytest.fixture()
def srf(tmp_path):
    body = layout(0, [0, 1, 2], b"high") + layout(1, [5], b"LFP ch20") + layout(2, [6], b"LFP ch7")
    body += message(b"MU", 0, DAYS - 1, b"user") + message(b"MS", 2_000_000, DAYS, b"Recording started") + digital(5, 9)
    body += display(10, DAYS, 110, b"x = 1\ny = 2")
    for k, t in enumerate((100, 260)):
        body += continuous(b"PS", t, 0, HIGH[k])
        body += continuous(b"PC", t, 2, [k, 2]) + continuous(b"PC", t, 1, [k, 1])
    body += digital(20, 1) + digital(300, 2) + display(280, DAYS, 100)
    path = tmp_path / "a.srf"
    path.write_bytes(header() + body)
    return str(path)


def test_index_and_samples(spark, srf):
    index = surf.record_index(spark, [srf])
    kinds = {r.kind: r["count"] for r in index.groupBy("kind").count().collect()}
    assert kinds == {"L": 3, "MU": 1, "MS": 1, "VD": 3, "D": 2, "PS": 2, "PC": 4}
    got = surf.read_records(index).orderBy("t").collect()
    assert [r.t for r in got] == [100, 260] and all((np.array(r.data) == h).all() for r, h in zip(got, HIGH))
    low = surf.lowpass_records(index).orderBy("t").collect()
    assert [(r.t, r.chans, r.adchans, r.nsamples) for r in low] == [(100, [20, 7], [5, 6], 2), (260, [20, 7], [5, 6], 2)]
    shapes = surf.layouts(index).orderBy("probe").collect()
    assert [(r.probe, r.nchans, r.rate, r.adchans, r.text, r.shdelay) for r in shapes] == [(0, 3, 25000, [0, 1, 2], "high", 7), (1, 1, 25000, [5], "LFP ch20", 7), (2, 1, 25000, [6], "LFP ch7", 7)]
    when = surf.start_datetime(index).first().datetime
    assert when == datetime.datetime(1899, 12, 30) + datetime.timedelta(days=DAYS) - datetime.timedelta(seconds=2)
    assert [(r.display, r.t, r.value) for r in surf.stimulus_edges(index).orderBy("t").collect()] == [(10, 20, 1), (280, 300, 2)]
    assert [(r.display, r.text) for r in surf.text_headers(index).collect()] == [(10, "x = 1\ny = 2")]
    late = surf.out_of_order(index).collect()
    assert late == [] or {r.kind for r in late} <= {"D"}
    shown = index.filter("kind = 'D'").orderBy("t").first()
    assert shown.params[0] == 0.5 and shown.params[-1] is None and shown.screen == [1, 2, 3, 4, 5, 6] and shown.name == "movie"


def test_damaged_files(spark, srf, tmp_path):
    raw = open(srf, "rb").read()
    for bad in (b"xx" + raw[2:], raw + b"QQ", raw + b"PE" + b"\0" * 40, raw[:-3]):
        path = tmp_path / "b.srf"
        path.write_bytes(bad)
        with pytest.raises(Exception, match="srf file|tag|supported|ends inside"):
            surf.record_index(spark, [str(path)]).collect()
    uneven = raw + continuous(b"PC", 900, 1, [1, 2])
    (tmp_path / "c.srf").write_bytes(uneven)
    with pytest.raises(Exception, match="lacks some"):
        surf.lowpass_records(surf.record_index(spark, [str(tmp_path / "c.srf")])).collect()


def test_records_by_stretches_and_kept_index(spark, srf, tmp_path):
    """Small batches, several files; only files that changed are parsed again."""
    import os
    import shutil

    two, folder = str(tmp_path / "b.srf"), str(tmp_path / "kept")
    shutil.copy(srf, two)
    index = surf.stored_index(spark, [srf, two], folder)
    plain = surf.record_index(spark, [srf, two])
    assert sorted(map(repr, index.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
    got = {(r.file, r.seq): r.data for r in surf.read_records(index, batch_bytes=1).collect()}
    assert got == {(r.file, r.seq): r.data for r in surf.read_records(plain).collect()} and {f for f, _ in got} == {srf, two} and len(got) == 4
    rows = spark.read.parquet(folder).count()
    surf.stored_index(spark, [srf, two], folder)
    assert spark.read.parquet(folder).count() == rows
    with open(two, "ab") as f:
        f.write(digital(99, 1))
    os.utime(two, (1, 1))
    again = surf.stored_index(spark, [two], folder)
    assert again.filter("kind = 'VD'").count() == plain.filter("kind = 'VD'").count() // 2 + 1
    assert surf.stored_index(spark, [srf], folder).count() == plain.count() // 2


def test_label_repair(spark):
    rows = [("f", k, "L", 0, k, None, None, [k], f"ch{c}", "uMap54_2b") for k, c in enumerate([20, 17, 14, 11, 81, 51, 22, 22, 24, 25])]
    rows += [("f", 100 + k, "PC", 5, k, 3, 10 * k, None, None, None) for k in range(10)]
    index = spark.createDataFrame(rows, "file string, seq long, kind string, t long, probe int, nsamples int, offset long, adchans array<int>, text string, name string")
    index = index.selectExpr("*", "1 AS nchans", "1000 AS rate", "0 AS shdelay", "array(1) AS extgain", "1 AS intgain")
    assert surf.lowpass_records(index).first().chans == [20, 17, 14, 11, 8, 5, 22, 2, 24, 25]


# ---------------------------------------------------------------- exports


def test_dat_export(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = rng.integers(-500, 500, (3, 1000)).astype(float)
    rows = [(c, t, float(data[c, t])) for c in range(3) for t in range(1000) if not 300 <= t < 350]
    samples = spark.createDataFrame(rows, "chan int, ti long, v double")
    path = str(tmp_path / "x.dat")
    n = exports.write_dat(samples, path, rate=25000.0, uv_per_ad=0.5, probe="p", block=128)
    got = np.fromfile(path, "<i2").reshape(-1, 3).T
    want = np.rint(data / 0.5)
    want[:, 300:350] = 0
    assert n == 1000 and (got == want).all()
    side = json.loads(open(path + ".json").read())
    assert side["nchans"] == 3 and side["chans"] == [0, 1, 2] and side["sample_rate"] == 25000.0 and side["nsamples_offset"] == 0
    null = spark.createDataFrame([(100, 120)], "ti0 long, ti1 long")
    exports.write_dat(samples, path, rate=25000.0, uv_per_ad=0.5, probe="p", block=128, saturated=null, pad=5)
    got = np.fromfile(path, "<i2").reshape(-1, 3).T
    want[:, 95:125] = 0
    assert (got == want).all()
    with pytest.raises(Exception, match="int16"):
        exports.write_dat(samples.selectExpr("chan", "ti", "v * 1000 AS v"), path, rate=25000.0, uv_per_ad=0.5, probe="p")


def test_text_exports(spark, srf, tmp_path):
    index = surf.record_index(spark, [srf])
    exports.write_all(index, str(tmp_path / "out"))
    got = {p.name: np.frombuffer(p.read_bytes(), "<i8").reshape(-1, 2).tolist() for p in (tmp_path / "out").glob("*.din")}
    assert got == {"a_10.din": [[20, 1]], "a_280.din": [[300, 2]]}
    assert (tmp_path / "out" / "a_10.textheader").read_text() == "x = 1\ny = 2"
    spikes = spark.createDataFrame([(0, 30, 2, 1), (1, 10, 1, 2), (2, 10, 3, 0)], "sid long, t long, chan int, nid long")
    assert [tuple(r) for r in exports.tschid(spikes).collect()] == [(10, 1, 2), (10, 3, 0), (30, 2, 1)]
    waves = spark.createDataFrame([(0, [1, 2], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), (1, [2, 3], [[7.0, 8.0, 9.0], [0.0, 0.0, 0.0]])], "sid long, chans array<int>, wave array<array<double>>")
    flat = exports.spike_waves(waves, [2], 1, 3).orderBy("sid").collect()
    assert [(r.sid, r.flat) for r in flat] == [(0, [5.0, 6.0]), (1, [8.0, 9.0])]


def test_kilosort_files():
    m = exports.kilosort_config("/x/a.dat", 3, 25000.0)
    assert "ops.NchanTOT = 3;" in m and "ops.fs = 25000" in m and "'/x/a.dat'" in m
    table = exports.channel_map([(4, 0.0, 10.0), (2, 5.0, 20.0)])
    assert table == [(1, 0, 4, 0.0, 10.0, 1), (2, 1, 2, 5.0, 20.0, 1)]
