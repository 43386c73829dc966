"""Fits in batches, wavelet coefficients, normality over partitions, sparse and kept components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.functions import batch_fits
from voltloom.operators import clustering, decompose, extract


def test_temporal_fits_find_planted_parameters(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for k in range(300):
        n = int(rng.integers(40, 60))
        p0, p1 = sorted(rng.choice(np.arange(8, 30), 2, replace=False).tolist())
        p1 = max(p1, p0 + 5)
        v0, v1, s0, s1, off = -rng.uniform(50, 200), rng.uniform(20, 120), rng.uniform(40, 90), rng.uniform(60, 160), rng.uniform(-10, 10)
        t = np.arange(n) * 20.0
        v = v0 * np.exp(-((t - p0 * 20) ** 2) / (2 * s0**2)) + v1 * np.exp(-((t - p1 * 20) ** 2) / (2 * s1**2)) + off
        rows.append((k, v.tolist(), p0, p1, float(v[p0]), float(v[p1])))
        want.append((v0, v1, s0, s1, off))
    rows += [(900, [], 3, 5, 1.0, 2.0), (901, None, 3, 5, 1.0, 2.0), (902, [1.0, None, 2.0], 0, 2, None, 1.0)]
    df = spark.createDataFrame(rows, "sid long, v array<double>, peak0 int, peak1 int, V0 double, V1 double")
    got = {r.sid: r for r in extract.temporal_fits(df.repartition(4), 20.0).collect()}
    assert len(got) == 303 and not any(got[k].settled for k in (900, 901, 902))
    good = [k for k in range(300) if got[k].settled and got[k].rmse < 0.01]
    assert len(good) >= 285
    for k in good:
        r = got[k]
        assert np.allclose((r.V0, r.V1, r.s0, r.s1, r.Voff), want[k], rtol=0.01, atol=0.5), (k, r, want[k])


@pytest.mark.parametrize("kind", ["x0y0s_sym", "x0y0_sym", "x0y0", "s", "sxsy", "y0", "sy"])
def test_spatial_fits(kind):
    """Every variant finds what it may move, with the rest at its true value; derivatives agree with differences."""
    rng = np.random.default_rng(2)
    n, m = 60, 14
    x, y = rng.uniform(0, 60, (n, m)), rng.uniform(0, 400, (n, m))
    true = np.stack([rng.uniform(10, 50, n), rng.uniform(100, 300, n), rng.uniform(40, 80, n), rng.uniform(40, 80, n)], 1)
    free, wide = batch_fits.SPATIAL[kind]
    if kind not in ("sxsy", "x0y0"):
        true[:, 3] = true[:, 2]
    height = np.full(n, 100.0)
    w = 100 * np.exp(-((x - true[:, :1]) ** 2) / (2 * true[:, 2:3] ** 2) * wide - (y - true[:, 1:2]) ** 2 / (2 * true[:, 3:] ** 2))
    mask = rng.random((n, m)) < 0.9
    start = true.copy()
    for places in free:
        for c in places:
            start[:, c] = true[:, c] * (0.85 if c > 1 else 1) + (0 if c > 1 else 12)
    p, cost, settled = batch_fits.fit_spatial(kind, start, height, x, y, w, mask)
    fixed = [c for c in range(4) if c not in {c for places in free for c in places}]
    assert (p[:, fixed] == start[:, fixed]).all() and settled.mean() > 0.9
    assert np.median(np.abs(p - true).max(1)) < 1e-3 and cost.mean() < 1
    model = batch_fits.spatial_model(kind, start, height, x, y)
    q = np.stack([start[:, places[0]] for places in free], 1)
    f, j = model(q, np.arange(n))
    for k in range(q.shape[1]):
        d = np.zeros_like(q)
        d[:, k] = 1e-4
        assert np.allclose((model(q + d, np.arange(n))[0] - f) / 1e-4, j[:, :, k], atol=1e-3)


def test_spatial_fits_on_spikes(spark):
    probe = {c: (0.0 if c % 2 else 50.0, 25.0 * c) for c in range(20)}
    rows = []
    for k in range(50):
        chans = list(range(k % 8, k % 8 + 9))
        x0, y0, s = 20.0, 25.0 * (k % 8 + 4) + 5, 55.0
        rows.append((k, chans, [float(90 * np.exp(-((probe[c][0] - x0) ** 2 + (probe[c][1] - y0) ** 2) / (2 * s * s))) for c in chans]))
    rows.append((99, [], []))
    got = {r.sid: r for r in extract.spatial_fits(spark.createDataFrame(rows, "sid long, chans array<int>, w array<double>"), probe).collect()}
    assert not got[99].settled and all(got[k].settled and got[k].rmse < 6 and abs(got[k].y0 - (25.0 * (k % 8 + 4) + 5)) < 15 for k in range(50))
    with pytest.raises(Exception, match="not of the probe"):
        extract.spatial_fits(spark.createDataFrame([(1, [77], [1.0])], "sid long, chans array<int>, w array<double>"), probe).collect()


def plain_haar(v):
    out, a = [], np.array(v, float)
    while len(a) > 1:
        if len(a) % 2:
            a = np.append(a, a[-1])
        out.append((a[::2] - a[1::2]) / 2**0.5)
        a = (a[::2] + a[1::2]) / 2**0.5
    return np.concatenate([a, *out[::-1]])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 50])
def test_haar(spark, n):
    v = np.random.default_rng(n).normal(size=n).tolist()
    got = spark.createDataFrame([(v,)], "v array<double>").select(extract.haar(F.col("v"), n).alias("c")).first().c
    assert np.allclose(got, plain_haar(v)) and len(got) == extract.haar_size(n)


def plain_ks(x):
    from math import erf

    x = np.sort(x)
    f = np.array([0.5 * (1 + erf(v / 2**0.5)) for v in x])
    k = np.arange(1, len(x) + 1)
    return max((k / len(x) - f).max(), (f - (k - 1) / len(x)).max())


@pytest.mark.parametrize("parts", [1, 8, 30])
def test_normality_over_partitions(spark, parts):
    """A hot unit, ties and small units; partitions cut units anywhere."""
    rng = np.random.default_rng(3)
    rows = [(0, rng.normal(size=3).tolist()) for _ in range(2000)] + [(1, np.round(rng.normal(size=3) * 2, 1).tolist()) for _ in range(300)]
    rows += [(2, [0.0, 0.0, 5.0])] * 40 + [(None, [1.0, None, float("nan")])] + [(3, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.u, r.i): (r.n, r.ks) for r in extract.normality(spark.createDataFrame(rows, "u long, v array<double>"), "u", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for u in (0, 1, 2, None):
        for i in range(3):
            x = [v[i] for a, v in rows if a == u and v is not None and v[i] is not None and v[i] == v[i]]
            if x:
                want[u, i] = (len(x), plain_ks(x))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-6)


def test_least_normal(spark):
    ks = spark.createDataFrame([(g, i, float((i * 7 + g) % 11)) for g in range(2) for i in range(11)], "u int, i int, ks double")
    assert [r.i for r in extract.least_normal(ks, None, 2).orderBy(F.desc("ks")).collect()] == [6, 9]
    top = extract.least_normal(ks, "u", 5).groupBy("u").count().collect()
    assert all(r["count"] == 5 for r in top)


def test_sparse_components(spark):
    rng = np.random.default_rng(5)
    true = np.zeros((20, 2))
    true[2:6, 0], true[10:13, 1] = 0.5, 3**-0.5
    x = rng.normal(size=(600, 2)) * [6, 4] @ true.T + rng.normal(size=(600, 20)) * 0.3
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "sid long, v array<double>")
    cov = np.cov(x.T, ddof=0)
    b = decompose.sparse_loadings(cov, 2, 0.05)
    assert np.allclose(np.abs(b.T @ true), np.eye(2), atol=0.05) and (b == 0).mean() > 0.7
    got = decompose.sparse_pca(df.filter("v IS NOT NULL").repartition(5), "v", 2, 0.05).toPandas().sort_values("sid")
    assert np.allclose(got[["sc0", "sc1"]].to_numpy(), (x - x.mean(0)) @ b, atol=1e-6)
    halves = [decompose.moments(df.filter(f"sid % 2 = {k}"), "v") for k in (0, 1)]
    _, mean, both = decompose._moments(decompose.merged(*halves))
    assert np.allclose(both, cov) and np.allclose(mean, x.mean(0))
    # optimality of the regression: no coordinate can lower it
    g, c = cov / np.linalg.eigvalsh(cov).max(), cov @ rng.normal(size=20) * 0.1
    beta = decompose.lasso(g, c, 0.1, 0.1, np.zeros(20))
    grad = g @ beta - c + 0.1 * beta
    assert (np.abs(grad[beta == 0]) <= 0.1 + 1e-6).all() and np.allclose(grad[beta != 0], -0.1 * np.sign(beta[beta != 0]), atol=1e-6)


def test_kept_components(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(g, k, rng.normal(size=4).tolist()) for g in (1, 2, None) for k in range(20 * (g or 3), 20 * (g or 3) + 15)]
    schema, folder = "nid long, sid long, v array<double>", str(tmp_path / "kept")
    fitted = []

    def fit(df):
        fitted.append({r.nid for r in df.select("nid").distinct().collect()})
        return clustering.components(df, ["nid"], "sid", "v", "nmf", 2)

    def ask(rows, params="nmf,2"):
        out, new = decompose.cached(spark.createDataFrame(rows, schema).repartition(3), ["nid"], "sid", "v", folder, params, fit)
        return {r.sid: r.comp for r in out.collect()}, {r.nid for r in new.collect()}

    first, new = ask(rows)
    assert new == {1, 2, None} == fitted[0] and len(first) == 45
    again, new = ask(rows[::-1])
    assert new == set() and again == first and len(fitted) == 1
    changed = [(g, k, [9.0] * 4 if k == 41 else v) for g, k, v in rows]
    third, new = ask(changed)
    assert new == {2} == fitted[1] and {k for k in third if third[k] != first[k]} <= {k for g, k, _ in rows if g == 2}
    assert ask(rows)[1] == set() and ask(rows, "nmf,3")[1] == {1, 2, None}
