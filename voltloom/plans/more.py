"""Further registered queries: selections of spikes, checks, imports, geometry, event-time windows, kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import detection as D
from ..operators import relational as R
from ..operators import signal as S
from ..operators import spikes as K
from ..session import table
from ..sources import events as EV
from ..sources import probes as P
from .catalog import LNG, PTS, SIG, SITES, SPK, long_waves, points, query, r6, rounded, signal, sites, spikes, us

# ---------------------------------------------------------------- selections


@query(f"WITH {SPK} SELECT sid, nid FROM spk WHERE nid IN ('click', 'view')")
def unit_rows(spark, sf):
    """Rows of selected units (P18): a semi join."""
    chosen = spark.createDataFrame([("click",), ("view",)], "nid string")
    return spikes(spark, sf).join(F.broadcast(chosen), "nid", "left_semi").select("sid", "nid")


@query(f"WITH {SPK}, r AS (SELECT sid, nid, row_number() OVER (PARTITION BY nid ORDER BY md5(sid::VARCHAR), sid) AS k FROM spk) SELECT sid, nid FROM r WHERE k <= 20")
def random_sample(spark, sf):
    """Up to 20 spikes of each unit in an order that looks random and repeats."""
    return R.top_k(spikes(spark, sf).withColumn("_h", F.md5(F.col("sid").cast("string"))), ["nid"], ["_h", "sid"], 20).select("sid", "nid")


@query(f"WITH {SPK}, r AS (SELECT sid, nid, row_number() OVER (PARTITION BY nid ORDER BY t, sid) AS k FROM spk) SELECT sid, nid FROM r WHERE k > 30 AND k <= 50")
def sliding_sample(spark, sf):
    """Members 30 to 50 of each unit in time order."""
    return R.top_k(spikes(spark, sf), ["nid"], ["t", "sid"], 50).filter("rank > 30").select("sid", "nid")


@query(f"WITH {SPK} SELECT s.sid, s.chan % 25 AS chan, n.n_nationkey AS site FROM spk s JOIN nation n ON abs(n.n_nationkey - s.chan % 25) <= 1")
def rasters(spark, sf):
    """A line for each spike in view and each channel it locks out (P25)."""
    s = spikes(spark, sf).withColumn("chan", F.col("chan") % 25)
    lock = F.filter(F.array(F.col("chan") - 1, F.col("chan"), F.col("chan") + 1), lambda c: (c >= 0) & (c < 25))
    return s.select("sid", "chan", F.explode(lock).alias("site"))


@query(f"WITH {SITES}, d AS (SELECT a.chan, b.chan AS near, row_number() OVER (PARTITION BY a.chan ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.chan) AS k FROM sites a, sites b) SELECT chan, near, k AS rank FROM d WHERE k <= 4")
def nearest_channels(spark, sf):
    """The four nearest channels of each channel."""
    d = D.distances(sites(spark, sf)).select(F.col("a").alias("chan"), F.col("b").alias("near"), "d")
    return R.top_k(d, ["chan"], ["d", "near"], 4).select("chan", "near", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {LNG}, p AS (SELECT sid, chan, max(v) - min(v) AS ptp FROM lng GROUP BY sid, chan), m AS (SELECT sid, chan, row_number() OVER (PARTITION BY sid ORDER BY ptp DESC, chan) AS k FROM p) SELECT l.sid, l.ti, round(l.v, 6) + 0.0 AS v FROM lng l JOIN m USING (sid, chan) WHERE k = 1")
def maxchan_wave(spark, sf):
    """The waveform on each spike's largest channel."""
    w = long_waves(spark, sf)
    top = w.groupBy("sid", "chan").agg((F.max("v") - F.min("v")).alias("ptp"))
    top = top.groupBy("sid").agg(F.min_by("chan", F.struct(-F.col("ptp"), F.col("chan"))).alias("chan"))
    return w.join(top, ["sid", "chan"]).select("sid", "ti", r6(F.col("v")).alias("v"))


@query("SELECT vec_id, round(embedding[3]::DOUBLE + 10 * embedding[1]::DOUBLE + 100 * embedding[64]::DOUBLE, 4) + 0.0 AS taken FROM embeddings")
def row_take(spark, sf):
    """Gather of array elements by an index array, per row."""
    at = F.array(F.lit(2), F.lit(0), F.lit(63))
    got = F.transform(at, lambda i: F.element_at(F.col("embedding").cast("array<double>"), i + 1))
    return table(spark, sf, "embeddings").select("vec_id", (rounded(got[0] + 10 * got[1] + 100 * got[2], 4) + 0.0).alias("taken"))


@query(f"WITH {SPK} SELECT sid, t - 500 AS t0, t + 1000 AS t1, (30 + round_even(250 / 40.0, 0))::INTEGER AS ti FROM spk")
def change_window(spark, sf):
    """New window limits, and peak positions shifted by the samples gained in front."""
    s = spikes(spark, sf).withColumn("t0", F.col("t") - 250).withColumn("ti", F.lit(30))
    return s.select("sid", (F.col("t0") - 250).alias("t0"), (F.col("t") + 1000).alias("t1"), (F.col("ti") + F.rint(F.lit(250 / 40.0)).cast("int")).alias("ti"))


@query(f"WITH {SPK} SELECT sid FROM spk WHERE nid IS NULL OR nid NOT IN ('click', 'view')")
def unsorted_spikes(spark, sf):
    """Spikes of no unit (P17): an anti join."""
    chosen = spark.createDataFrame([("click",), ("view",)], "nid string")
    return spikes(spark, sf).join(F.broadcast(chosen), "nid", "left_anti").select("sid")


@query(f"WITH {SIG} SELECT chan, ti, CASE WHEN v > 0 THEN 'rise' ELSE 'fall' END AS edge FROM (SELECT *, lag(v > 0) OVER (PARTITION BY chan ORDER BY ti) AS was FROM sig) WHERE was <> (v > 0)")
def stim_edges(spark, sf):
    """Rising and falling edges of a digital line."""
    w = Window.partitionBy("chan").orderBy("ti")
    s = signal(spark, sf).withColumn("up", F.col("v") > 0).withColumn("was", F.lag(F.col("v") > 0).over(w))
    return s.filter("was <> up").select("chan", "ti", F.when(F.col("up"), "rise").otherwise("fall").alias("edge"))


# ---------------------------------------------------------------- checks and keys


@query("SELECT vec_id, list_max(list_transform(range(1, 3), lambda k: abs(embedding[k]::DOUBLE - embedding[1]::DOUBLE))) < 0.05 AS lead_flat, abs(embedding[64]::DOUBLE - embedding[63]::DOUBLE) < 0.05 AS trail_flat FROM embeddings")
def wave_padding(spark, sf):
    """Waves whose first or last two points are constant, as padding leaves them."""
    e = F.col("embedding").cast("array<double>")
    flat = lambda a: F.forall(a, lambda x: F.abs(x - a[0]) < 0.05)
    return table(spark, sf, "embeddings").select("vec_id", flat(F.slice(e, 1, 2)).alias("lead_flat"), flat(F.slice(e, -2, 2)).alias("trail_flat"))


@query(f"WITH {PTS}, r AS (SELECT label, z, row_number() OVER (PARTITION BY label ORDER BY z, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM pts) SELECT label, round(z, 6) + 0.0 AS p95 FROM r WHERE k = floor(0.95 * n)::BIGINT + 1")
def sigma_p95(spark, sf):
    """The sorted value at index int(0.95 n)."""
    w = Window.partitionBy("label")
    x = points(spark, sf).withColumn("k", F.row_number().over(w.orderBy("z", "vec_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.filter("k = floor(0.95D * n) + 1").select("label", r6(F.col("z")).alias("p95"))


@query(f"WITH {SITES}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM sites) SELECT chan FROM sites, c WHERE sqrt(power(x - cx, 2) + power(y - cy, 2)) <= 400")
def select_channels(spark, sf):
    """Channels near a mean position (F8)."""
    s = sites(spark, sf)
    c = s.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return s.join(F.broadcast(c)).filter(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) <= 400).select("chan")


@query("SELECT user_id, event_type, count(*) AS count FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicated_keys(spark, sf):
    """Keys that are not unique."""
    e = table(spark, sf, "events").select(F.struct("user_id", "event_type").alias("k"))
    return R.duplicated_keys(e, "k").select("k.user_id", "k.event_type", "count")


@query("SELECT item_id, sha1(text) AS digest, md5(concat_ws('|', item_id::VARCHAR, text)) AS memo FROM benchmark")
def content_keys(spark, sf):
    """Content digest and cache key."""
    return table(spark, sf, "benchmark").select("item_id", F.sha1(F.col("text")).alias("digest"), F.md5(F.concat_ws("|", F.col("item_id").cast("string"), "text")).alias("memo"))


@query("SELECT c_custkey, regexp_extract(c_name, '#(0*)([0-9]+)', 2)::BIGINT AS n FROM customer")
def label_numbers(spark, sf):
    """Channel number inside a label."""
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", "#(0*)([0-9]+)", 2).cast("long").alias("n"))


@query("SELECT ts_day, array_to_string(list(user_id ORDER BY user_id), ',') AS probes, count(*) AS n FROM (SELECT DISTINCT epoch_us(ts) // 86400000000 AS ts_day, user_id FROM events) GROUP BY ts_day")
def multichannel_records(spark, sf):
    """Records of equal time stamp put together in probe order."""
    e = table(spark, sf, "events").select(F.floor(us() / 86_400_000_000).alias("ts_day"), "user_id").distinct()
    g = e.groupBy("ts_day").agg(F.sort_array(F.collect_list("user_id")).alias("p"), F.count(F.lit(1)).alias("n"))
    return g.select("ts_day", F.concat_ws(",", F.col("p").cast("array<string>")).alias("probes"), "n")


@query("SELECT event_type, count(DISTINCT user_id % 3) = 1 AS same_gain FROM events GROUP BY 1")
def equal_gain(spark, sf):
    """Whether all members of a track agree in a setting."""
    return table(spark, sf, "events").groupBy("event_type").agg((F.count_distinct(F.col("user_id") % 3) == 1).alias("same_gain"))


@query(f"WITH {SPK} SELECT s.sid, s.t, r.n_nationkey AS site FROM spk s JOIN nation r ON r.n_nationkey = s.chan")
def index_to_time(spark, sf):
    """Positional equi join of sample numbers with their meaning."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("chan"), F.col("n_nationkey").alias("site"))
    return spikes(spark, sf).join(n, "chan").select("sid", "t", "site")


@query(f"WITH {SPK} SELECT printf('%.6f', t / 1e6) AS t, nid, chan FROM spk WHERE nid = 'click'")
def spike_csv(spark, sf):
    """Export lines of good units (K3)."""
    units = spark.createDataFrame([("click", True), ("view", False)], "nid string, good boolean")
    return EV.csv_rows(spikes(spark, sf), units)


@query(f"WITH {SPK} SELECT sid, CASE WHEN sid % 5 = 0 THEN t + 1 ELSE t END AS t FROM spk")
def update_rows(spark, sf):
    """Rows replaced by key."""
    s = spikes(spark, sf).select("sid", "t")
    return EV.update_rows(s, s.filter("sid % 5 = 0").withColumn("t", F.col("t") + 1), "sid")


@query(f"WITH {SPK} SELECT sid, 1 AS tis, 2 AS dt, chan AS lockchans, '' AS notes FROM spk")
def migrate_session(spark, sf):
    """An old spike table brought up to date."""
    old = spikes(spark, sf).select("sid", F.lit(1).alias("phasetis"), F.lit(2).alias("dphase"), F.lit(3).alias("cid"), F.array("chan").alias("chans"))
    return EV.migrate(old, "0.5").select("sid", "tis", "dt", F.col("lockchans")[0].alias("lockchans"), "notes")


# ---------------------------------------------------------------- geometry


def _probe(spark, sf):
    return sites(spark, sf).select((F.col("chan") % 5).cast("string").alias("probe"), F.col("chan").cast("int").alias("chan"), F.lit(0.0).alias("x"), (F.floor(F.col("chan") / 5) * 65.0).alias("y"))


@query("SELECT (n_nationkey % 5)::VARCHAR AS probe, count(*) AS nchans, 1::BIGINT AS ncols, count(*) AS nrows, min(n_nationkey)::INTEGER AS chan0, 65.0 AS ysep FROM nation GROUP BY 1")
def probe_summary(spark, sf):
    """G1."""
    return P.summary(_probe(spark, sf))


@query("SELECT (n_nationkey % 5)::VARCHAR AS probe, (n_nationkey + k * 5)::INTEGER AS chan, k * 200.0 AS x, floor(n_nationkey / 5) * 65.0 AS y FROM nation, (SELECT unnest(range(2)) AS k)")
def probe_shanks(spark, sf):
    """G2."""
    return P.shanks(_probe(spark, sf), [(0.0, 0.0), (200.0, 0.0)])


@query("SELECT n_nationkey::INTEGER AS chan, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) - 1 AS place FROM nation")
def channel_order(spark, sf):
    """O2, O3, G4."""
    p = table(spark, sf, "nation").select(F.lit("p").alias("probe"), F.col("n_nationkey").cast("int").alias("chan"), F.lit(0.0).alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    return P.order_by_axes(p, ["x", "y"], [True, False]).select("chan", F.col("place").cast("long").alias("place"))


@query("SELECT n_nationkey::INTEGER AS chan, CASE WHEN n_nationkey < 20 THEN (24 - n_nationkey)::INTEGER END AS ad_chan FROM nation")
def adapter_lookup(spark, sf):
    """J4, G3, G4."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("chan"))
    a = n.filter("chan < 20").select(F.col("chan").alias("probe_chan"), (24 - F.col("chan")).alias("ad_chan"))
    return P.adapt(n, a)


# ---------------------------------------------------------------- event-time windows


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_rates(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window(F.col("ts"), "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH p AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pr FROM events),
s AS (SELECT *, sum(CASE WHEN pr IS NULL OR t - pr >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT user_id, min(t) AS t0, count(*) AS n FROM s GROUP BY user_id, g""")
def session_counts(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", us().alias("t"))
    return R.sessions(e, ["user_id"], "t", 7_200_000_000, None, ["t", "event_id"]).groupBy("user_id", "session").agg(F.min("t").alias("t0"), F.count(F.lit(1)).alias("n")).drop("session")


# ---------------------------------------------------------------- kernels, without SQL twins


def _frames(spark, sf):
    """Frames of all channels: each 16 of them are a probe with a recording of its own, referenced by itself."""
    rec = F.concat(F.lit("events-"), F.floor(F.col("chan") / 16).cast("string"))
    s = signal(spark, sf).select(rec.alias("rec"), F.col("chan").cast("int").alias("chan"), "ti", "v")
    return K.frames_from_samples(S.gap_fill(s, ["rec", "chan"]), 50.0, 4000, 1000)


def _filtered(name: str, settings: K.Settings):
    def run(spark, sf):
        def kernel(it):
            for pdf in it:
                import numpy as np

                pdf = pdf[["rec", "block", "chans", "data", "tres_us"]].copy()
                pdf["rms"] = [float(np.sqrt((K.preprocess(np.stack([np.asarray(r, float) for r in d]), 1e6 / t, settings) ** 2).mean())) for d, t in zip(pdf["data"], pdf["tres_us"], strict=True)]
                yield pdf[["rec", "block", "rms"]]

        return _frames(spark, sf).mapInPandas(kernel, "rec string, block long, rms double")

    run.__name__ = name
    return query()(run)


highpass_rms = _filtered("highpass_rms", K.Settings())
zero_phase_rms = _filtered("zero_phase_rms", K.Settings(filter="butter-zero-phase"))
wavelet_rms = _filtered("wavelet_rms", K.Settings(filter="wavelet", car="mean"))
resampled_rms = _filtered("resampled_rms", K.Settings(filter=None, car=None, resample=2))


@query()
def detect_spikes(spark, sf):
    """Frames of 16 channels searched block by block; ids count within a recording."""
    probe = {k: (0.0, 50.0 * k) for k in range(16)}
    cfg = K.Settings(filter=None, car=None, threshold="fixed", fixed_uv=40.0, window_us=(-250.0, 500.0))
    f = _frames(spark, sf).withColumn("chans", F.transform("chans", lambda c: F.pmod(c, F.lit(16))))
    found = K.detect(f, probe, cfg).withColumn("chan", F.col("chan") + 16 * F.split("rec", "events-")[1].cast("int"))
    return K.with_ids(found).select("rec", "id", "t", "chan", "Vpp", "x0", "y0", "sx")


@query()
def pca_components(spark, sf):
    """F2."""
    return C.pca(table(spark, sf, "embeddings"), "embedding", 5).select("vec_id", *[rounded(f"pc{k}", 4).alias(f"pc{k}") for k in range(5)])


@query()
def ica_components(spark, sf):
    """F3 within each unit."""
    return C.components(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding", "ica", 5)


@query()
def nmf_components(spark, sf):
    """F5 within each unit."""
    return C.components(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding", "nmf", 5)


@query()
def ascent_clusters(spark, sf):
    """C1-C5 within each unit, on the first three features."""
    return C.cluster(points(spark, sf), ["label"], "vec_id", ["x", "y", "z"], C.Ascent(sigma=0.3, alpha=1.0))


@query()
def align_best(spark, sf):
    """D20 on vectors read as eight channels of eight samples."""
    e = F.col("embedding").cast("array<double>")
    wave = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice(e, c * 8 + 1, F.lit(8)))
    w = table(spark, sf, "embeddings").select(F.col("label").alias("nid"), F.col("vec_id").alias("sid"), wave.alias("wave"))
    return K.align_spikes(w).select("sid", "nid", "shift")
