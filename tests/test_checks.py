"""Streams, template checks and session migrations on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators import checks, spikes, streams
from voltloom.sources import events


def test_stream_settings():
    s = streams.Stream.highpass(25000.0, [2, 0, 1])
    assert (s.rate, s.car, s.chans, s.is_raw) == (50000.0, "median", (0, 1, 2), False)
    raw = s.with_settings(filter=None, car=None, rate=25000.0)
    assert raw.is_raw and raw.describe()["f0_hz"] is None and s.describe()["f0_hz"] == 300.0
    assert streams.Stream.lowpass(25000.0, [0]).rate == 1000.0
    with pytest.raises(ValueError, match="divide"):
        streams.Stream.lowpass(25500.0, [0])
    with pytest.raises(ValueError, match="no channels"):
        s.enable([7])
    assert [x.car for x in streams.same_for_all([s, s], car="mean")] == ["mean", "mean"]
    with pytest.raises(ValueError, match="differ"):
        streams.same_for_all([s, s.enable([1])])
    assert raw.on_grid(400.0) == 10
    with pytest.raises(ValueError, match="grid"):
        raw.on_grid(410.0, percent=20)


def test_stream_reads(spark):
    v = np.random.default_rng(0).integers(-50, 50, (3, 40))
    samples = spark.createDataFrame([(c, t, float(v[c, t])) for c in range(3) for t in range(40)], "chan int, ti long, v double")
    s = streams.Stream.highpass(25000.0, range(3), filter=None, rate=25000.0)
    got = {(r.chan, r.ti): r.v for r in s.read(samples, 400.0, 10_000.0, [1]).collect()}
    want = v - np.median(v, axis=0)
    assert got == {(1, t): want[1, t] for t in range(10, 40)}
    two = s.enable([0, 1]).with_settings(car="mean")
    got = {(r.chan, r.ti): r.v for r in two.read(samples, 0.0, 40.0).collect()}
    assert got == {(c, 0): v[c, 0] - v[:2, 0].mean() for c in (0, 1)}
    rows = spark.createDataFrame([(-5, 3), (2, 99), (50, 60), (-9, -2)], "a long, b long")
    cut = rows.select(*streams.clamp(F.col("a"), F.col("b"), F.lit(0), F.lit(10))).collect()
    assert [tuple(r) for r in cut] == [(0, 3), (2, 10), (10, 10), (0, 0)]
    assert [r.ti for r in streams.in_view(samples.filter("chan = 0"), "ti", 10, 2, 2).orderBy("ti").collect()] == [8, 9, 10, 11]
    assert samples.limit(1).select(streams.to_16_bit(F.lit(-3)).alias("x")).first().x == -48


def test_templates(spark):
    w = {1: [[0, -5, 1, 4], [0, 1, -6, 2], [1, -7, 0, 8]], 2: [[0, 9, 1, -4], [3, 7, -6, 2], [0, 5, -1, -8]]}
    rows = [(n, c, k, float(x)) for n, cs in w.items() for c, xs in enumerate(cs) for k, x in enumerate(xs)]
    waves = spark.createDataFrame(rows, "nid long, chan int, ti int, v double")
    got = {r.nid: r.aligni for r in checks.initial_alignment(waves).collect()}
    spread = {n: [np.std([np.argmin(x) for x in cs]), np.std([np.argmax(x) for x in cs])] for n, cs in w.items()}
    assert got == {n: int(b < a) for n, (a, b) in spread.items()}
    trigger = spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "nid long, chan int, at int")
    assert [tuple(r) for r in checks.misaligned_templates(waves, trigger, most=0).collect()] == [(2, 1)]
    assert checks.misaligned_templates(waves, trigger).count() == 0


def test_align_to_peaks(spark):
    rows = [(0, 0, 100, 90, 120, -5.0, 8.0, 7), (1, 0, 100, 90, 120, 5.0, -8.0, 7), (2, 1, 100, 90, 120, 5.0, -8.0, 7), (3, 1, 100, 90, 120, -5.0, 8.0, 7)]
    s = spark.createDataFrame(rows, "sid long, aligni int, t long, t0 long, t1 long, V0 double, V1 double, dt int")
    low = {r.sid: (r.aligni, r.t, r.t0, r.t1) for r in checks.align_to(s, "min").collect()}
    assert low == {0: (0, 100, 90, 120), 1: (1, 107, 97, 127), 2: (1, 100, 90, 120), 3: (0, 93, 83, 113)}
    high = {r.sid: (r.aligni, r.t) for r in checks.align_to(s, "max").collect()}
    assert high == {0: (1, 107), 1: (0, 100), 2: (0, 93), 3: (1, 100)}


def test_lists_and_marks(spark):
    s = spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "sid long, nid long")
    m = spark.createDataFrame([(0, 1), (2, 3)], "sid long, nid long")
    assert sorted(tuple(r) for r in checks.inconsistent(s, m).collect()) == [(2, 2), (2, 3)]
    units = spark.createDataFrame([(1, True), (2, None), (3, False)], "nid long, good boolean")
    assert {r.nid: r.good for r in checks.set_good(units, [1, 2]).collect()} == {1: False, 2: True, 3: False}
    assert {r.nid: r.good for r in checks.set_good(units, [3], True).collect()} == {1: True, 2: False, 3: True}


def test_density_and_rotation(spark):
    x = np.random.default_rng(1).normal(size=(4000, 2)) * [3, 0.5] + [10, -2]
    points = spark.createDataFrame([(0, float(a), float(b)) for a, b in x], "nid long, x double, y double")
    got = {r.bin: r for r in checks.density_histogram(points, "nid", ["x", "y"], 0.5).collect()}
    r = np.sqrt((((x - x.mean(0)) / x.std(0)) ** 2).sum(1))
    count = np.bincount((r / 0.5).astype(int))
    assert {k: v.n for k, v in got.items()} == {k: int(c) for k, c in enumerate(count) if c}
    assert sum(v.density for v in got.values()) == pytest.approx(1) and max(abs(v.density - v.normal) for v in got.values()) < 0.03
    turned = checks.rotate(spark.createDataFrame([(1.0, 0.0, 2.0)], "x double, y double, z double"), ("x", "y", "z"), 90).first()
    assert (turned.x, turned.y, turned.z) == pytest.approx((0, 1, 2))


def test_ragged_frames_keep_time(spark):
    """Channels that start late or lack samples keep their places; nothing is cut to the shortest."""
    rows = [(0, t, float(t)) for t in range(100)] + [(1, t, float(t)) for t in range(40, 100)] + [(2, t, float(t)) for t in range(0, 100, 2)]
    s = spark.createDataFrame([("r", *r) for r in rows], "rec string, chan int, ti long, v double")
    for f in spikes.frames_from_samples(s, 50.0, 2000, 500).collect():
        size = {len(d) for d in f.data}
        assert len(size) == 1
        at = round(f.t0_us / 50)
        for c, d in zip(f.chans, f.data):
            for k, v in enumerate(d):
                t = at + k
                there = c == 0 or c == 1 and t >= 40 or c == 2 and t % 2 == 0
                assert (v == t) if there else (v != v or v is None), (f.block, c, t, v)


def test_settings_migration():
    old = {"version": "0.3", "sort": {"detector": {"chans": [0, 1, 2]}, "nspikes": 4}}
    new = events.migrate_settings(old["sort"], "0.3")
    assert new["tw"] == (-500, 500) and new["filtmeth"] is None and new["car"] is None and new["adapter"] is None and new["user"] == "" and new["detector"]["chans"] == [0, 1, 2]
    kept = events.migrate_settings({"tw": (-100, 100), "car": "Median", "probe": "old_name"}, "0.6", renamed={"old_name": "new_name"})
    assert kept["tw"] == (-100, 100) and kept["car"] == "Median" and kept["probe"] == "new_name"
    with pytest.raises(ValueError):
        events.migrate_settings({}, "9.9")


@pytest.mark.parametrize("name", ["stream_mean_reference", "stream_time_range"])
def test_streams_take_every_channel(spark, tmp_path, name):
    """Against the SQL: channel numbers of any size, as larger tables have them."""
    import duckdb

    from voltloom.plans import built

    rows = [(k, k % 7 * 1500, float(k * k % 11)) for k in range(70)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = getattr(built, name)(spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) == (70 if name == "stream_mean_reference" else 49)
    assert sorted((r.chan, r.ti, r.v) for r in got) == sorted(duck.execute(built.SQL[name]).fetchall())


def test_stream_of_all_channels(spark):
    """Without channels named, what a stream of all of them gives; some may be chosen later."""
    v = np.random.default_rng(1).integers(-50, 50, (3, 400))
    samples = spark.createDataFrame([(c * 9000, t, float(v[c, t])) for c in range(3) for t in range(400)], "chan int, ti long, v double")
    whole, named = streams.Stream.highpass(25000.0), streams.Stream.highpass(25000.0, [0, 9000, 18000])
    got, want = ({(r.chan, r.ti): r.v for r in s.read(samples, 0.0, 16_000.0, [9000]).collect()} for s in (whole, named))
    assert got == want and len(got) > 700
    assert whole.enable([9000, 0]).chans == (0, 9000)


def test_rounding_agrees_with_the_sql(spark, tmp_path):
    """Medians of two samples of six decimals end in a half of the last one: it rounds as in the SQL."""
    import duckdb

    from voltloom.plans import built

    v = np.random.default_rng(3).uniform(0, 100, 4000).round(6)
    rows = [(k, k % 400, float(x)) for k, x in enumerate(v)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = built.stream_time_range(spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) == 2800
    assert sorted((r.chan, r.ti, r.v) for r in got) == sorted(duck.execute(built.SQL["stream_time_range"]).fetchall())
