"""Scans over blocks give what a window over the whole key gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.operators import detection, metrics, relational, scans, signal


def same(a, b):
    cols = sorted(a.columns)
    got, want = (sorted(map(repr, df.select(cols).collect())) for df in (a, b))
    assert got == want and len(got)


@pytest.fixture(scope="module")
def sparse(spark):
    """Keys with gaps far wider than a block, blocks of one row, ties, nulls and a null key."""
    rng = np.random.default_rng(0)
    rows = [(k, int(t), i, None if rng.random() < 0.3 else int(rng.integers(0, 9))) for k in (1, 2, None) for i, t in enumerate(np.sort(rng.choice([*range(300), *range(5000, 5040), 90_000, -70], 150)))]
    return spark.createDataFrame([(3, 7, 0, None), *rows], "k int, t long, i long, v long").repartition(6).cache()


@pytest.mark.parametrize("width", [1, 10, 100_000])
def test_scans(sparse, width):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("t", "i")
    got = scans.lagged(sparse, ["k"], ["t", "i"], ["t", "v"], width, "b").select("k", "i", "b.t", "b.v")
    same(got, sparse.select("k", "i", F.lag("t").over(w).alias("t"), F.lag("v").over(w).alias("v")))
    got = scans.running_sum(sparse, ["k"], ["t", "i"], F.coalesce("v", F.lit(0)), width, "s").select("k", "i", "s")
    same(got, sparse.select("k", "i", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("s")))
    got = scans.last_known(sparse, ["k"], ["t", "i"], "v", width, "l").select("k", "i", "l")
    same(got, sparse.select("k", "i", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l")))


@pytest.mark.parametrize("width", [3, 64, 10_000])
def test_operators_by_blocks(spark, sparse, width):
    rng = np.random.default_rng(1)
    rows = [(c, t, float(v)) for c in range(3) for t, v in enumerate(np.cumsum(rng.normal(size=900)) % 7 - 3) if not 200 <= t < 260]
    x = spark.createDataFrame(rows, "chan int, ti long, v double").repartition(5)
    same(detection.sharpness(x, ["chan"], block=width), detection.sharpness(x, ["chan"]))
    flagged = x.withColumn("sat", F.abs("v") > 2.5)
    same(signal.saturated_ranges(flagged, ["chan"], 2, block=width), signal.saturated_ranges(flagged, ["chan"], 2))
    same(signal.squeeze_gaps(x, ["chan"], block=width), signal.squeeze_gaps(x, ["chan"]))
    s = sparse.select(F.col("k").alias("nid"), "t", F.col("i").alias("sid"))
    same(metrics.isi(s, block=width), metrics.isi(s))
    same(relational.sessions(s, ["nid"], "t", 50, 20, ["t", "sid"], block=width), relational.sessions(s, ["nid"], "t", 50, 20, ["t", "sid"]))
    right = s.filter("nid IS NOT NULL AND sid % 4 = 0").dropDuplicates(["nid", "t"]).select("nid", F.col("t").alias("rt"), F.col("sid").alias("w"))
    left = s.filter("nid IS NOT NULL")
    same(relational.asof(left, right, "t", "rt", ["w"], ["nid"], block=width), relational.asof(left, right, "t", "rt", ["w"], ["nid"]))


def test_grids_are_made_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(signal, "GRID", 10)
    d = spark.createDataFrame([(1, -25, 1.0), (1, 33, 2.0), (2, 7, 5.0)], "k int, ti long, v double")
    got = {(r.k, r.ti): r.v for r in signal.gap_fill(d, ["k"]).collect()}
    assert got == {(1, t): {-25: 1.0, 33: 2.0}.get(t, 0.0) for t in range(-25, 34)} | {(2, 7): 5.0}


@pytest.mark.parametrize("auto", [False, True])
@pytest.mark.parametrize("bins", [7, 20])
def test_correlogram_without_pairs(spark, auto, bins):
    """Against the histogram of all pairs: ties, negative times, a hot moment."""
    rng = np.random.default_rng(bins)
    rows = [(int(t), k) for k, t in enumerate(np.concatenate([rng.integers(-5000, 5000, 400), np.full(60, 77), rng.integers(70, 90, 100)]))]
    s = spark.createDataFrame(rows, "t long, sid long").repartition(4)
    a, b = (s, s) if auto else (s.filter("sid % 3 > 0"), s.filter("sid % 3 < 2"))
    got = {r.bin: r.n for r in metrics.spike_correlogram(a, b, 300, bins, auto=auto).collect()}
    pairs = metrics.xcorr_pairs(a.withColumnRenamed("sid", "sid"), b, 300, auto=auto)
    assert got == {r.bin: r.n for r in metrics.correlogram(pairs, 300, bins).collect()}


def test_pairs_come_in_order(spark):
    """Inside a task: buckets, then left rows, then right rows, so that files of pairs stay small."""
    rng = np.random.default_rng(3)
    s = spark.createDataFrame([(int(t), k) for k, t in enumerate(rng.integers(-5000, 5000, 300))], "t long, sid long").repartition(4)
    rows = metrics.xcorr_pairs(s.filter("sid % 2 = 0"), s.filter("sid % 2 = 1"), 300).withColumn("part", F.spark_partition_id()).collect()
    keys = [(r.part, r.tb // 600, r.ta, r.ka, r.tb, r.kb) for r in rows]
    t = {r.sid: r.t for r in s.collect()}
    assert keys == sorted(keys) and {(r.ka, r.kb) for r in rows} == {(i, j) for i in range(0, 300, 2) for j in range(1, 300, 2) if -300 <= t[j] - t[i] < 300}
    assert len(rows) == len({(r.ka, r.kb) for r in rows})


def test_files_of_dense_pairs_stay_small(spark, tmp_path):
    """Buckets of thousands of rows on both sides: the ids of the right come again within a short stretch, not once a left row."""
    s = spark.range(0, 5000, 1, 4).selectExpr("id * 7919 AS sid", "id % 50 * 20 AS t", "id div 50 % 2 AS side")
    metrics.xcorr_pairs(s.filter("side = 0"), s.filter("side = 1"), 600).select("ka", "kb", "dt").write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n == sum(50 * 50 for x in range(0, 1000, 20) for y in range(0, 1000, 20) if -600 <= y - x < 600)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.25 * n


@pytest.mark.parametrize("chunk", [1, 8, 1000])
def test_packed_pairs_are_all_pairs(spark, monkeypatch, chunk):
    """Chunks of any length, many tasks, a key beside the time, nulls, a hot moment: the pairs of the plain join."""
    monkeypatch.setattr(relational, "CHUNK", chunk)
    monkeypatch.setattr(relational, "TASK_ROWS", 16)
    rng = np.random.default_rng(chunk)
    times = [int(t) for t in np.concatenate([rng.integers(-900, 900, 200), np.full(40, 77)])]
    rows = [(None if k % 17 == 0 else t, None if k % 13 == 0 else k % 3, k) for k, t in enumerate(times)]
    a = spark.createDataFrame(rows, "ta long, ga int, ka long").repartition(3)
    b = a.selectExpr("ka AS kb", "ga AS gb", "ta AS tb")
    for by in ([], [("ga", "gb")]):
        got = relational.band_join(a, b, "ta", "tb", -100, 50, by, order=(["ta", "ka"], ["tb", "kb"]))
        assert got.columns == ["ta", "ga", "ka", "kb", "gb", "tb"]
        same(got, relational.band_join(a, b, "ta", "tb", -100, 50, by))
