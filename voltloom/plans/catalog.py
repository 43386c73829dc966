"""Registered queries over the driver tables, each with its DuckDB twin.

``events`` stand for a multichannel signal (user = channel, order = sample
number, value - 20 = voltage) or for spike trains (one row = one spike);
``embeddings`` for feature vectors of labelled units; ``nation`` for sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import detection as D
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import signal as S
from ..operators import units as U
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- base frames

SIG = "sig AS (SELECT user_id AS chan, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ti, value - 20 AS v, event_id FROM events)"
SPK = "spk AS (SELECT event_id AS sid, event_type AS nid, user_id AS chan, epoch_us(ts) AS t, value FROM events)"
PTS = "pts AS (SELECT vec_id, label, embedding, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
LNG = "lng AS (SELECT vec_id AS sid, label AS nid, (k - 1) // 8 AS chan, (k - 1) % 8 AS ti, embedding[k]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings))"
SITES = "sites AS (SELECT n_nationkey AS chan, n_regionkey * 56.0 AS x, n_nationkey * 65.0 AS y FROM nation)"


def us(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def signal(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("chan"), (F.row_number().over(w) - 1).cast("long").alias("ti"), (F.col("value") - 20).alias("v"), "event_id")


def spikes(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("sid"), F.col("event_type").alias("nid"), F.col("user_id").alias("chan"), us().alias("t"), "value")


def points(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding", *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")])


def long_waves(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sid"), F.col("label").alias("nid"), F.posexplode("embedding").alias("k", "_v"))
    return e.select("sid", "nid", F.floor(F.col("k") / 8).alias("chan"), (F.col("k") % 8).cast("long").alias("ti"), F.col("_v").cast("double").alias("v"))


def sites(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("chan"), (F.col("n_regionkey") * 56.0).alias("x"), (F.col("n_nationkey") * 65.0).alias("y"))


def rounded(c, digits: int):
    """Rounded half away from zero as the SQL twins do it: the product with the power of ten, not the shortest decimal."""
    scale = 10.0**digits
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def r6(c):
    """Rounded for comparison; -0.0 becomes 0.0."""
    return rounded(c, 6) + 0.0


def q6(c: str) -> str:
    return f"round({c}, 6) + 0.0"


# ---------------------------------------------------------------- flagship


@query(f"""
WITH {SIG}, n AS (SELECT chan, quantile_disc(abs(v), 0.5) / 0.6745 AS noise FROM sig GROUP BY chan),
c AS (SELECT *, (v > 0) AS up, lag(v > 0) OVER w AS was FROM sig WINDOW w AS (PARTITION BY chan ORDER BY ti)),
s AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> up THEN 1 ELSE 0 END) OVER (PARTITION BY chan ORDER BY ti) AS seg FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY chan, seg ORDER BY abs(v) DESC, ti) AS rn, count(*) OVER (PARTITION BY chan, seg) AS np,
      max(seg) OVER (PARTITION BY chan) AS last FROM s)
SELECT r.chan, count(*) AS n_peaks, round(sum(v * abs(v) / np), 4) AS total_sharp FROM r JOIN n USING (chan)
WHERE rn = 1 AND seg > 1 AND seg < last AND v <> 0 AND abs(v) >= greatest(round_even(noise * 1.5, 0), 10) GROUP BY r.chan
""")
def threshold_peak_counts(spark: SparkSession, sf: str) -> DataFrame:
    sig = signal(spark, sf)
    limits = D.thresholds(sig, ["chan"], mult=1.5, fixed=10.0)
    peaks = D.threshold_peaks(D.sharpness(sig, ["chan"]), limits, ["chan"])
    return peaks.groupBy("chan").agg(F.count(F.lit(1)).alias("n_peaks"), rounded(F.sum("sharp"), 4).alias("total_sharp"))


@query(f"""
WITH {SIG}, c AS (SELECT *, (v > 0) AS up, lag(v > 0) OVER w AS was FROM sig WINDOW w AS (PARTITION BY chan ORDER BY ti)),
s AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> up THEN 1 ELSE 0 END) OVER (PARTITION BY chan ORDER BY ti) AS seg FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY chan, seg ORDER BY abs(v) DESC, ti) AS rn, count(*) OVER (PARTITION BY chan, seg) AS np,
      max(seg) OVER (PARTITION BY chan) AS last FROM s)
SELECT chan, ti, {q6('v')} AS v, {q6('v * abs(v) / np')} AS sharp FROM r WHERE rn = 1 AND seg > 1 AND seg < last
""")
def sharpness(spark, sf):
    return D.sharpness(signal(spark, sf), ["chan"]).select("chan", "ti", r6(F.col("v")).alias("v"), r6(F.col("sharp")).alias("sharp"))


# ---------------------------------------------------------------- scalars, slices


@query("SELECT event_id, round_even(value / 0.195, 0)::INTEGER AS ad, round(round_even(value / 0.195, 0) * 0.195, 6) AS uv, round(round_even(value, 0) * (1e7 / (32768.0 * 10 * 100)), 6) AS gained FROM events")
def unit_convert(spark, sf):
    ad = X.uv_to_ad(F.col("value"), 0.195)
    return table(spark, sf, "events").select("event_id", ad.alias("ad"), rounded(X.ad_to_uv(F.rint(F.col("value") / 0.195), 0.195), 6).alias("uv"), rounded(X.gain_converter(F.rint("value"), 10, 100), 6).alias("gained"))


@query("SELECT event_id, round_even(value, 0)::BIGINT AS r, floor(value)::BIGINT AS f, ceil(value)::BIGINT AS c FROM events")
def int_rounding(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", X.intround(v).alias("r"), X.intfloor(v).alias("f"), X.intceil(v).alias("c"))


@query(r"""SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS stripped,
regexp_extract(c_name, '^[\x20-\x7F\t\n\r]*') AS head, translate(c_name, ' .-', '___') AS matlab,
CASE WHEN ends_with(c_mktsegment, 'Y') THEN left(c_mktsegment, length(c_mktsegment) - 1) ELSE c_mktsegment END AS cut FROM customer""")
def string_helpers(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", X.strip_prefix(n, "Customer#").alias("stripped"), X.ascii_head(n).alias("head"), X.matlab_name(n).alias("matlab"), X.strip_suffix(F.col("c_mktsegment"), "Y").alias("cut"))


@query("SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 86400000000.0, 6) AS days FROM events")
def durations(spark, sf):
    zero = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", X.duration_us(F.col("ts"), zero).alias("us"), rounded(X.duration_days(F.col("ts"), zero), 6).alias("days"))


@query("SELECT n_nationkey, printf('#%02X%02X%02X', n_nationkey, n_regionkey * 50, 255 - n_nationkey) AS hex, n_nationkey AS red, (255 - n_nationkey)::INTEGER AS blue FROM nation")
def colours(spark, sf):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    h = X.rgb_hex(k, r * 50, 255 - k)
    return table(spark, sf, "nation").select("n_nationkey", h.alias("hex"), X.hex_rgb(h)[0].alias("red"), X.hex_rgb(h)[2].alias("blue"))


@query("SELECT vec_id, round(exp(-power(embedding[1]::DOUBLE - 0.5, 2) / (2 * 0.25)), 6) AS g, round(1 / (1 + power((embedding[1]::DOUBLE - 0.5) / 0.5, 2)), 6) AS c FROM embeddings")
def peak_models(spark, sf):
    x = F.col("embedding")[0].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", rounded(X.gaussian(x, 0.5, 0.5), 6).alias("g"), rounded(X.cauchy(x, 0.5, 0.5), 6).alias("c"))


@query(f"WITH {SIG} SELECT chan, ti, {q6('v')} AS v FROM sig WHERE ti >= 10 AND ti < 25")
def time_slice(spark, sf):
    return S.time_slice(signal(spark, sf), 500.0, 1250.0, 50.0).select("chan", "ti", r6(F.col("v")).alias("v"))


@query(f"WITH {SPK} SELECT sid, (round_even(t / 40.0, 0) * 40.0)::BIGINT AS t_near FROM spk")
def nearest_sample(spark, sf):
    return spikes(spark, sf).select("sid", S.nearest_sample(F.col("t"), 40.0).cast("long").alias("t_near"))


@query(f"""WITH {SPK}, r AS (SELECT chan, min(t) AS t0, max(t) + 1 AS t1 FROM spk GROUP BY chan),
b AS (SELECT *, unnest(range(t0, t1, 86400000000)) AS b0 FROM r)
SELECT chan, b0, least(b0 + 86400000000, t1) AS b1, greatest(b0 - 1000, t0) AS r0, least(least(b0 + 86400000000, t1) + 1000, t1) AS r1 FROM b""")
def block_plan(spark, sf):
    r = spikes(spark, sf).groupBy("chan").agg(F.min("t").alias("t0"), (F.max("t") + 1).alias("t1"))
    return S.blocks(r, 86_400_000_000, 1000).select("chan", "b0", "b1", "r0", "r1")


# ---------------------------------------------------------------- signal transforms

MIN = "m AS (SELECT event_id, user_id, value, date_trunc('hour', ts) AS bucket FROM events)"


def minutes(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value", F.date_trunc("hour", "ts").alias("bucket"))


@query(f"WITH {MIN}, g AS (SELECT bucket, median(value) AS md FROM m GROUP BY bucket) SELECT event_id, {q6('value - md')} AS car FROM m JOIN g USING (bucket)")
def car_median(spark, sf):
    return S.car(minutes(spark, sf), ["bucket"], "value").select("event_id", r6(F.col("car")).alias("car"))


@query(f"WITH {MIN}, g AS (SELECT bucket, avg(value) AS md FROM m GROUP BY bucket) SELECT event_id, {q6('value - md')} AS car FROM m JOIN g USING (bucket)")
def car_mean(spark, sf):
    return S.car(minutes(spark, sf), ["bucket"], "value", "mean").select("event_id", r6(F.col("car")).alias("car"))


@query(f"WITH {MIN} SELECT event_id, {q6('coalesce(lag(value) OVER w - lead(value) OVER w, 0)')} AS bipolar FROM m WINDOW w AS (PARTITION BY bucket ORDER BY user_id, event_id)")
def bipolar_ref(spark, sf):
    return S.bipolar(minutes(spark, sf), ["bucket"], ["user_id", "event_id"], "value").select("event_id", r6(F.col("bipolar")).alias("bipolar"))


@query(f"WITH {SIG} SELECT chan, ti, {q6('v')} AS v FROM sig WHERE ti % 4 = 0")
def decimate(spark, sf):
    return S.decimate(signal(spark, sf), 4).select("chan", "ti", r6(F.col("v")).alias("v"))


@query(f"WITH {SIG}, c AS (SELECT *, count(*) OVER (PARTITION BY chan) AS n FROM sig) SELECT chan, ti FROM c WHERE ti % (CASE WHEN n > 30 THEN n // 30 + 1 ELSE 1 END) = 0")
def systematic_sample(spark, sf):
    return S.systematic_sample(signal(spark, sf), ["chan"], ["ti"], 30).select("chan", "ti")


@query(f"WITH {SIG} SELECT chan, ti, v <= -19 OR v >= 80 AS sat FROM sig")
def saturation_flag(spark, sf):
    return S.saturation(signal(spark, sf), low=-19, high=80).select("chan", "ti", "sat")


_SATR = f"""{SIG}, h AS (SELECT chan, ti FROM sig WHERE v <= -19 OR v >= 80),
p AS (SELECT *, sum(CASE WHEN pr IS NULL OR ti <> pr + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chan ORDER BY ti) AS i FROM (SELECT *, lag(ti) OVER (PARTITION BY chan ORDER BY ti) AS pr FROM h)),
r AS (SELECT chan, min(ti) - 2 AS lo, max(ti) + 3 AS hi FROM p GROUP BY chan, i),
q AS (SELECT *, max(hi) OVER (PARTITION BY chan ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
k AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY chan ORDER BY lo, hi) AS g FROM q),
sat AS (SELECT chan, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY chan, g)"""


@query(f"WITH {_SATR} SELECT chan, lo, hi FROM sat")
def saturation_null_ranges(spark, sf):
    return S.saturated_ranges(S.saturation(signal(spark, sf), low=-19, high=80), ["chan"], 2)


@query(f"""WITH {SIG}, f AS (SELECT *, v >= 80 AS bad FROM sig), n AS (
SELECT *, last_value(CASE WHEN NOT bad THEN ti END IGNORE NULLS) OVER a AS ta, last_value(CASE WHEN NOT bad THEN v END IGNORE NULLS) OVER a AS va,
first_value(CASE WHEN NOT bad THEN ti END IGNORE NULLS) OVER b AS tb, first_value(CASE WHEN NOT bad THEN v END IGNORE NULLS) OVER b AS vb FROM f
WINDOW a AS (PARTITION BY chan ORDER BY ti ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY chan ORDER BY ti ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT chan, ti, {q6('CASE WHEN NOT bad THEN v ELSE coalesce(va + (vb - va) * (ti - ta) / (tb - ta), va, vb, v) END')} AS ramped FROM n""")
def saturation_ramp(spark, sf):
    return S.ramp(signal(spark, sf).withColumn("bad", F.col("v") >= 80), ["chan"]).select("chan", "ti", r6(F.col("ramped")).alias("ramped"))


@query(f"""WITH {SPK}, i AS (SELECT chan, t AS lo, t + 3600000000 AS hi FROM spk),
q AS (SELECT *, max(hi) OVER (PARTITION BY chan ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM i),
k AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY chan ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM q)
SELECT chan, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY chan, g""")
def interval_merge(spark, sf):
    s = spikes(spark, sf).select("chan", F.col("t").alias("lo"), (F.col("t") + 3_600_000_000).alias("hi"))
    return R.merge_intervals(s, ["chan"])


@query("""WITH d AS (SELECT user_id AS chan, epoch_us(ts) // 86400000000 AS ti, sum(value) AS v FROM events GROUP BY 1, 2),
g AS (SELECT chan, unnest(range(min(ti), max(ti) + 1)) AS ti FROM d GROUP BY chan)
SELECT g.chan, g.ti, round(coalesce(d.v, 0), 6) + 0.0 AS v FROM g LEFT JOIN d ON g.chan = d.chan AND g.ti = d.ti""")
def gap_fill(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("chan"), F.floor(us() / 86_400_000_000).alias("ti")).agg(F.sum("value").alias("v"))
    return S.gap_fill(d, ["chan"]).select("chan", "ti", r6(F.col("v")).alias("v"))


@query(f"WITH {SIG}, w AS (SELECT chan, ti, list(v) OVER (PARTITION BY chan ORDER BY ti ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS win FROM sig) SELECT chan, ti, {q6('list_sum(win)')} AS total FROM w WHERE len(win) = 3")
def rolling_windows(spark, sf):
    w = S.rolling(signal(spark, sf), ["chan"], ["ti"], 3)
    return w.select("chan", "ti", r6(F.aggregate("win", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {SIG}, b AS (SELECT chan, ti, (v > 0)::INTEGER AS s FROM sig), w AS (SELECT chan, ti, list(s) OVER (PARTITION BY chan ORDER BY ti ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS win FROM b) SELECT chan, ti FROM w WHERE win = [0, 1, 0]")
def subarray_search(spark, sf):
    b = signal(spark, sf).select("chan", "ti", (F.col("v") > 0).cast("int").alias("v"))
    return S.find_subarray(b, ["chan"], ["ti"], [0, 1, 0]).select("chan", "ti")


@query(f"""WITH {SIG}, b AS (SELECT chan, ti, (v > 0)::INTEGER AS v FROM sig), c AS (SELECT *, lag(v) OVER (PARTITION BY chan ORDER BY ti) AS p FROM b),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> v THEN 1 ELSE 0 END) OVER (PARTITION BY chan ORDER BY ti) AS i FROM c), n AS (SELECT chan, i, count(*) AS n FROM r GROUP BY chan, i)
SELECT chan, arg_min(n, i) AS lead_n, arg_max(n, i) AS trail_n, count(*) AS runs FROM n GROUP BY chan""")
def constant_edges(spark, sf):
    b = signal(spark, sf).select("chan", "ti", (F.col("v") > 0).cast("int").alias("v"))
    return S.constant_edges(b, ["chan"], ["ti"])


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda k: k * embedding[greatest(k - 3, 1)]::DOUBLE)), 4) + 0.0 AS right3, round(list_sum(list_transform(range(1, 65), lambda k: k * embedding[least(k + 2, 64)]::DOUBLE)), 4) + 0.0 AS left2 FROM embeddings")
def shift_padded(spark, sf):
    w = F.col("embedding").cast("array<double>")
    total = lambda a: rounded(F.aggregate(F.transform(a, lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x), 4) + 0.0
    return table(spark, sf, "embeddings").select("vec_id", total(S.shift_padded(w, 3)).alias("right3"), total(S.shift_padded(w, -2)).alias("left2"))


@query(f"WITH {SIG}, p AS (SELECT *, max(v) OVER (PARTITION BY chan) - min(v) OVER (PARTITION BY chan) AS ptp FROM sig) SELECT chan, ti, {q6('v / CASE WHEN ptp = 0 THEN 1 ELSE ptp END')} AS norm FROM p")
def normalise_amplitude(spark, sf):
    return S.normalise_amplitude(signal(spark, sf), ["chan"]).select("chan", "ti", r6(F.col("norm")).alias("norm"))


@query(f"WITH {SIG} SELECT chan, ti, {q6('0.25 * coalesce(lag(v) OVER w, 0) + 0.5 * v + 0.25 * coalesce(lead(v) OVER w, 0)')} AS fir FROM sig WINDOW w AS (PARTITION BY chan ORDER BY ti)")
def fir_filter(spark, sf):
    return S.fir(signal(spark, sf), ["chan"], "ti", [0.25, 0.5, 0.25]).select("chan", "ti", r6(F.col("fir")).alias("fir"))


@query(f"WITH {SIG} SELECT a.ti, {q6('a.v - b.v')} AS v FROM sig a JOIN sig b ON a.ti = b.ti WHERE a.chan = 1 AND b.chan = 2")
def wave_difference(spark, sf):
    s = signal(spark, sf)
    return S.add_waves(s.filter("chan = 1"), s.filter("chan = 2"), ["ti"], -1).select("ti", r6(F.col("v")).alias("v"))


@query(f"WITH {SIG} SELECT chan, ti, (round_even(v, 0)::INTEGER * 16)::INTEGER AS shifted, trunc(v)::INTEGER AS cut FROM sig")
def bit_shift(spark, sf):
    return signal(spark, sf).select("chan", "ti", S.bit_shift(F.rint("v"), 4).alias("shifted"), F.col("v").cast("int").alias("cut"))


# ---------------------------------------------------------------- noise and thresholds


@query(f"WITH {SIG} SELECT chan, {q6('quantile_disc(abs(v), 0.5) / 0.6745')} AS noise FROM sig GROUP BY chan")
def noise_median(spark, sf):
    return D.noise(signal(spark, sf), ["chan"]).select("chan", r6(F.col("noise")).alias("noise"))


@query(f"WITH {SIG} SELECT chan, {q6('stddev_pop(v)')} AS noise FROM sig GROUP BY chan")
def noise_std(spark, sf):
    return D.noise(signal(spark, sf), ["chan"], how="stdev").select("chan", r6(F.col("noise")).alias("noise"))


@query(f"""WITH {SIG}, n AS (SELECT chan, ti // 20 AS block, quantile_disc(abs(v), 0.5) / 0.6745 AS noise FROM sig GROUP BY 1, 2)
SELECT chan, block, greatest(round_even(noise * 1.5, 0), 40) + 0.0 AS thresh, round_even(greatest(round_even(noise * 1.5, 0), 40) * 1.5, 0) + 0.0 AS ppthresh FROM n""")
def threshold_dynamic(spark, sf):
    s = signal(spark, sf).withColumn("block", F.floor(F.col("ti") / 20))
    return D.thresholds(s, ["chan", "block"], mult=1.5).select("chan", "block", (F.col("thresh") + 0.0).alias("thresh"), (F.col("ppthresh") + 0.0).alias("ppthresh"))


@query(f"WITH {SITES} SELECT a.chan AS a, b.chan AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS d FROM sites a, sites b")
def distance_matrix(spark, sf):
    return D.distances(sites(spark, sf)).select("a", "b", rounded("d", 6).alias("d"))


@query(f"WITH {SITES} SELECT a.chan, array_to_string(list(b.chan ORDER BY b.chan), ',') AS nbhd FROM sites a, sites b WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 200 GROUP BY a.chan")
def neighbourhood(spark, sf):
    return D.neighbourhoods(sites(spark, sf), 200.0).select("chan", F.concat_ws(",", F.col("nbhd").cast("array<string>")).alias("nbhd"))


@query(f"WITH {PTS} SELECT label, round(sum(abs(z) * x) / sum(abs(z)), 6) + 0.0 AS x0, round(sum(abs(z) * y) / sum(abs(z)), 6) + 0.0 AS y0 FROM pts GROUP BY label")
def spatial_mean(spark, sf):
    return D.spatial_mean(points(spark, sf), ["label"], "z").select("label", r6(F.col("x0")).alias("x0"), r6(F.col("y0")).alias("y0"))


@query(f"WITH {SIG}, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM sig WINDOW w AS (PARTITION BY chan ORDER BY ti)) SELECT chan, ti FROM n WHERE a < v AND b < v")
def local_maxima(spark, sf):
    return D.local_maxima(signal(spark, sf), ["chan"], ["ti"]).select("chan", "ti")


@query(f"WITH {SPK} SELECT sid, row_number() OVER (PARTITION BY nid ORDER BY t, chan, sid) - 1 AS id FROM spk")
def temporal_order(spark, sf):
    return D.number_spikes(spikes(spark, sf), ["nid"], ["t", "chan", "sid"]).select("sid", F.col("id").cast("long").alias("id"))


# ---------------------------------------------------------------- spike trains


@query(f"WITH {SPK}, i AS (SELECT sid, t - lag(t) OVER (PARTITION BY chan ORDER BY t, sid) AS isi FROM spk) SELECT sid, isi FROM i WHERE isi IS NOT NULL")
def isi(spark, sf):
    return M.isi(spikes(spark, sf), "chan").select("sid", "isi")


@query(f"WITH {SPK}, i AS (SELECT nid, t - lag(t) OVER (PARTITION BY nid ORDER BY t, sid) AS isi FROM spk) SELECT nid, count(*) AS n FROM i WHERE isi < 60000000 GROUP BY nid")
def isi_violations(spark, sf):
    return M.isi_violations(spikes(spark, sf), 60_000_000)


@query(f"""WITH {SPK}, n AS (SELECT nid, sid, t, value, lead(t) OVER w AS t2, lead(sid) OVER w AS s2, lead(value) OVER w AS v2 FROM spk WINDOW w AS (PARTITION BY nid ORDER BY t, sid))
SELECT DISTINCT nid, CASE WHEN value < v2 THEN sid ELSE s2 END AS sid FROM n WHERE t2 - t <= 60000000""")
def duplicate_removal(spark, sf):
    return M.duplicates(spikes(spark, sf), 60_000_000, overlap="value")


@query(f"""WITH {SPK}, p AS (SELECT *, lag(t) OVER (PARTITION BY nid ORDER BY t, sid) AS pr FROM spk),
s AS (SELECT *, sum(CASE WHEN pr IS NULL OR t - pr >= 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY nid ORDER BY t, sid ROWS UNBOUNDED PRECEDING) AS session FROM p)
SELECT sid, session::BIGINT AS session, (t - min(t) OVER (PARTITION BY nid, session)) // 3600000000 AS piece FROM s""")
def reload_sessions(spark, sf):
    return R.sessions(spikes(spark, sf), ["nid"], "t", 900_000_000, 3_600_000_000, ["t", "sid"]).select("sid", "session", "piece")


_PAIRS = f"{SPK}, a AS (SELECT sid, t FROM spk WHERE nid = 'click'), b AS (SELECT sid, t FROM spk WHERE nid = 'view'), pairs AS (SELECT a.sid AS ka, b.sid AS kb, b.t - a.t AS dt FROM a JOIN b ON b.t - a.t >= -600000000 AND b.t - a.t < 600000000)"


def _pairs(spark, sf, a="click", b="view", auto=False):
    s = spikes(spark, sf)
    return M.xcorr_pairs(s.filter(F.col("nid") == a), s.filter(F.col("nid") == b), 600_000_000, auto=auto)


@query(f"WITH {_PAIRS} SELECT ka, kb, dt FROM pairs")
def xcorr_pairs(spark, sf):
    return _pairs(spark, sf).select("ka", "kb", "dt")


@query(f"WITH {_PAIRS} SELECT floor((dt + 600000000) / 60000000.0)::INTEGER AS bin, count(*) AS n FROM pairs GROUP BY 1")
def xcorr_hist(spark, sf):
    s = spikes(spark, sf)
    return M.spike_correlogram(s.filter("nid = 'click'"), s.filter("nid = 'view'"), 600_000_000, 20)


@query(f"WITH {_PAIRS.replace(chr(39) + 'view' + chr(39), chr(39) + 'click' + chr(39))} SELECT floor((dt + 600000000) / 60000000.0)::INTEGER AS bin, count(*) AS n FROM pairs WHERE dt <> 0 GROUP BY 1")
def autocorr_hist(spark, sf):
    s = spikes(spark, sf).filter("nid = 'click'")
    return M.spike_correlogram(s, s, 600_000_000, 20, auto=True)


@query("SELECT user_id, floor(least((value - 0) / 25.0, 11))::INTEGER AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 300 GROUP BY 1, 2")
def value_histogram(spark, sf):
    return R.histogram(table(spark, sf, "events"), F.col("value"), ["user_id"], 0.0, 300.0, 12)


@query("""SELECT e.event_id, arg_max(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS last_order FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id""")
def din_asof(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("last_order"))
    return R.asof(e, o, "ts", "o_orderdate", ["last_order"], ["user_id"]).filter("last_order IS NOT NULL").select("event_id", "last_order")


@query("""WITH a AS (SELECT event_id, epoch_us(ts) AS x0, epoch_us(ts) + 600000000 AS x1 FROM events WHERE event_type = 'purchase'),
b AS (SELECT event_id AS other, epoch_us(ts) AS y0, epoch_us(ts) + 300000000 AS y1 FROM events WHERE event_type = 'click')
SELECT event_id, other FROM a JOIN b ON x0 < y1 AND y0 < x1""")
def range_overlap(spark, sf):
    e = table(spark, sf, "events")
    a = e.filter("event_type = 'purchase'").select("event_id", us().alias("x0"), (us() + 600_000_000).alias("x1"))
    b = e.filter("event_type = 'click'").select(F.col("event_id").alias("other"), us().alias("y0"), (us() + 300_000_000).alias("y1"))
    return R.overlap_join(a, b, 600_000_000, "x0", "x1", "y0", "y1").select("event_id", "other")


@query("""WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS t FROM events), p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS pr FROM d),
s AS (SELECT *, sum(CASE WHEN pr IS NULL OR t <> pr + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS g FROM p)
SELECT user_id, min(t) AS t0, max(t) + 1 AS t1 FROM s GROUP BY user_id, g""")
def recording_gaps(spark, sf):
    d = table(spark, sf, "events").select("user_id", F.floor(us() / 86_400_000_000).alias("t"), F.lit(1).cast("long").alias("len")).distinct()
    return R.contiguous_ranges(d, ["user_id"], "t", "len")


@query("""WITH f AS (SELECT event_type AS rec, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1), z AS (SELECT min(t0) AS z FROM f),
u AS (SELECT event_type AS rec, event_id, epoch_us(ts) - t0 AS local FROM events JOIN f ON f.rec = event_type)
SELECT u.rec, u.event_id, u.local + f.t0 - z.z AS track_t FROM u JOIN f USING (rec), z""")
def track_concat(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("rec"), "event_id", us().alias("t"))
    first = e.groupBy("rec").agg(F.min("t").alias("t0"))
    zero = first.agg(F.min("t0").alias("z"))
    local = e.join(first, "rec").withColumn("local", F.col("t") - F.col("t0"))
    return local.join(F.broadcast(zero)).select("rec", "event_id", (F.col("local") + F.col("t0") - F.col("z")).alias("track_t"))


@query("SELECT user_id AS chan FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_chans(spark, sf):
    return R.common_members(table(spark, sf, "events").select(F.col("user_id").alias("chan"), "event_type"), "chan", "event_type")


@query(f"WITH {SIG}, p AS (SELECT chan, ti, v, lag(v) OVER (PARTITION BY chan ORDER BY ti) AS pr FROM sig) SELECT chan, ti FROM p WHERE pr > v")
def unsorted_order(spark, sf):
    return R.descents(signal(spark, sf), ["chan"], ["ti"], "v").select("chan", "ti")


@query("SELECT s.user_id, c.c_name AS name, c.c_custkey IS NOT NULL AS found FROM (SELECT DISTINCT user_id FROM events) s LEFT JOIN customer c ON c.c_custkey = s.user_id")
def argmatch(spark, sf):
    keys = table(spark, sf, "events").select("user_id").distinct()
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return R.argmatch(keys, names, "user_id")


@query("SELECT event_type, user_id FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY 1, 2) WHERE r <= 3")
def top_channels(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type", "user_id").count()
    return R.top_k(n, ["event_type"], [F.desc("count"), "user_id"], 3).select("event_type", "user_id")


@query("(SELECT user_id AS id, 'both' AS part FROM events INTERSECT SELECT c_custkey, 'both' FROM customer) UNION ALL (SELECT 'left' AND false, NULL FROM events WHERE false) UNION ALL (SELECT * FROM (SELECT user_id, 'left' FROM events EXCEPT SELECT c_custkey, 'left' FROM customer WHERE c_custkey % 2 = 0))".replace("(SELECT 'left' AND false, NULL FROM events WHERE false) UNION ALL ", ""))
def id_sets(spark, sf):
    a = table(spark, sf, "events").select(F.col("user_id").alias("id"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    both = a.intersect(b).withColumn("part", F.lit("both"))
    return both.unionByName(a.distinct().join(b.filter("id % 2 = 0"), "id", "left_anti").withColumn("part", F.lit("left")))


# ---------------------------------------------------------------- units


_TMP = f"{LNG}, z AS (SELECT nid, count(DISTINCT sid) AS size FROM lng GROUP BY nid), tmp AS (SELECT l.nid, chan, ti, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM lng l JOIN z USING (nid) GROUP BY l.nid, chan, ti, size HAVING count(*) * 2 >= size)"


@query(f"WITH {_TMP} SELECT nid, chan, ti, {q6('mean')} AS mean, {q6('std')} AS std, n FROM tmp")
def template_mean_std(spark, sf):
    return U.templates(long_waves(spark, sf)).select("nid", "chan", "ti", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "n")


@query(f"WITH {SPK}, z AS (SELECT nid, count(DISTINCT t // 86400000000) AS size FROM spk GROUP BY nid) SELECT s.nid, chan, count(DISTINCT t // 86400000000) AS n FROM spk s JOIN z USING (nid) GROUP BY s.nid, chan, size HAVING count(DISTINCT t // 86400000000) * 2 >= size")
def template_chan_majority(spark, sf):
    s = spikes(spark, sf).select("nid", "chan", F.floor(F.col("t") / 86_400_000_000).alias("sid")).distinct()
    t = U.templates(s.withColumn("ti", F.lit(0)).withColumn("v", F.lit(0.0)))
    return t.select("nid", "chan", "n")


@query(f"WITH {_TMP}, p AS (SELECT nid, chan, max(mean) - min(mean) AS ptp FROM tmp GROUP BY nid, chan), r AS (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY ptp DESC, chan) AS k FROM p) SELECT nid, chan, {q6('ptp')} AS ptp FROM r WHERE k = 1")
def unit_maxchan(spark, sf):
    return U.max_channel(U.templates(long_waves(spark, sf))).select("nid", "chan", r6(F.col("ptp")).alias("ptp"))


@query(f"WITH {_TMP} SELECT sid, t.nid, {q6('sqrt(avg(power(v - mean, 2)))')} AS rms FROM lng l JOIN tmp t ON l.chan = t.chan AND l.ti = t.ti GROUP BY sid, t.nid")
def rms_to_template(spark, sf):
    w = long_waves(spark, sf)
    return U.rms_to_templates(w.drop("nid"), U.templates(w)).select("sid", "nid", r6(F.col("rms")).alias("rms"))


@query(f"WITH {_TMP}, e AS (SELECT sid, t.nid, sqrt(avg(power(v - mean, 2))) AS rms FROM lng l JOIN tmp t ON l.chan = t.chan AND l.ti = t.ti GROUP BY sid, t.nid), r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY rms, nid) AS k FROM e) SELECT sid, nid, {q6('rms')} AS rms FROM r WHERE k = 1")
def match_best_unit(spark, sf):
    w = long_waves(spark, sf)
    return U.match_units(w.drop("nid"), U.templates(w)).select("sid", "nid", r6(F.col("rms")).alias("rms"))


@query(f"WITH {_TMP}, d AS (SELECT a.nid AS a, b.nid AS b, sqrt(avg(power(a.mean - b.mean, 2))) AS rms FROM tmp a JOIN tmp b ON a.chan = b.chan AND a.ti = b.ti AND a.nid <> b.nid GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rms, b) AS rank FROM d) SELECT a, b, {q6('rms')} AS rms, rank FROM r")
def most_similar_unit(spark, sf):
    return U.similar_units(U.templates(long_waves(spark, sf))).select("a", "b", r6(F.col("rms")).alias("rms"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PTS}, g AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM pts), m AS (SELECT label, median(x) AS x, median(y) AS y FROM pts GROUP BY label)
SELECT label, {q6('x')} AS x, {q6('y')} AS y, {q6('(x - mx) / sx')} AS norm_x, {q6('(y - my) / sy')} AS norm_y FROM m, g""")
def cluster_pos(spark, sf):
    p = U.positions(points(spark, sf), "label", ["x", "y"])
    return p.select("label", *[r6(F.col(c)).alias(c) for c in ("x", "y", "norm_x", "norm_y")])


@query(f"WITH {PTS}, g AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, avg(z) AS mz, stddev_pop(z) AS sz FROM pts) SELECT vec_id, {q6('(x - mx) / sx')} AS x, {q6('(y - my) / sx')} AS y, {q6('(z - mz) / sz')} AS z FROM pts, g")
def param_matrix(spark, sf):
    return U.parameter_matrix(points(spark, sf), "vec_id", ["x", "y", "z"], {"y": "x"}).select("vec_id", *[r6(F.col(c)).alias(c) for c in "xyz"])


@query(f"WITH {SPK} SELECT sid, dense_rank() OVER (PARTITION BY nid ORDER BY chan) AS part FROM spk")
def maxchan_split(spark, sf):
    return U.split_by(spikes(spark, sf), ["nid"], ["chan"]).select("sid", F.col("part").cast("long").alias("part"))


@query(f"WITH {SPK} SELECT sid, dense_rank() OVER (PARTITION BY nid ORDER BY chan % 3, chan % 5) AS part FROM spk")
def chancombo_split(spark, sf):
    s = spikes(spark, sf).withColumn("c3", F.col("chan") % 3).withColumn("c5", F.col("chan") % 5)
    return U.split_by(s, ["nid"], ["c3", "c5"]).select("sid", F.col("part").cast("long").alias("part"))


_POS = f"""{PTS}, m AS (SELECT label, median(x) AS x, median(y) AS y FROM pts WHERE label IN (0, 1) GROUP BY label),
l AS (SELECT max(x) FILTER (label = 0) AS ax, max(y) FILTER (label = 0) AS ay, max(x) FILTER (label = 1) AS bx, max(y) FILTER (label = 1) AS by_ FROM m),
pos AS (SELECT vec_id, label, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)) AS pos FROM pts, l WHERE label IN (0, 1))"""


@query(f"""WITH {_POS}, h AS (SELECT floor(pos * 5)::INTEGER AS bin, count(*) AS n FROM pos WHERE pos >= 0 AND pos < 1 GROUP BY 1),
g AS (SELECT r.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(5))::INTEGER AS bin) r LEFT JOIN h USING (bin)), c AS (SELECT (bin + 0.5) / 5 AS cut FROM g ORDER BY n, bin LIMIT 1)
SELECT vec_id, CASE WHEN pos < cut THEN 1 ELSE 2 END AS side FROM pos, c""")
def density_split(spark, sf):
    return U.density_split(points(spark, sf), "label", 0, 1, ["x", "y"], 5).select("vec_id", "side")


@query(f"""WITH {PTS}, m AS (SELECT label, median(x) AS mx, median(y) AS my FROM pts GROUP BY label), r AS (SELECT vec_id, p.label, sqrt(power(x - mx, 2) + power(y - my, 2)) AS r FROM pts p JOIN m USING (label)),
s AS (SELECT label, sqrt(avg(r * r)) AS scale FROM r GROUP BY label) SELECT vec_id, {q6('r')} AS r FROM r JOIN s USING (label) WHERE r > 1.5 * scale""")
def clean_radius(spark, sf):
    return U.beyond_radius(points(spark, sf), "label", ["x", "y"], 1.5).select("vec_id", r6(F.col("r")).alias("r"))


@query("WITH s AS (SELECT s_nationkey - 12 AS nid, avg(s_acctbal) AS y0 FROM supplier GROUP BY 1) SELECT nid, (row_number() OVER (PARTITION BY sign(nid) ORDER BY y0, nid) * sign(nid))::BIGINT AS new_nid FROM s WHERE nid <> 0")
def renumber_by_depth(spark, sf):
    s = table(spark, sf, "supplier").groupBy((F.col("s_nationkey") - 12).alias("nid")).agg(F.avg("s_acctbal").alias("y0"))
    return U.renumber(s, F.col("y0")).select("nid", F.col("new_nid").cast("long").alias("new_nid"))


def assigned(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_custkey") % 9).alias("nid"))


_ASG = "asg AS (SELECT o_orderkey AS sid, o_custkey % 9 AS nid FROM orders)"


@query(f"WITH {_ASG}, n AS (SELECT nid, count(*) AS c FROM asg WHERE nid IN (2, 4, 6) GROUP BY nid ORDER BY c DESC, nid LIMIT 1) SELECT a.sid, n.nid FROM asg a, n WHERE a.nid IN (2, 4, 6)")
def merge_units(spark, sf):
    return U.merge_units(assigned(spark, sf), [2, 4, 6])


@query(f"WITH {_ASG}, n AS (SELECT nid FROM asg WHERE nid IN (2, 4, 6) GROUP BY nid ORDER BY count(*) DESC, nid LIMIT 1) SELECT sid, CASE WHEN a.nid IN (2, 4, 6) THEN n.nid ELSE CASE WHEN a.nid = 3 THEN 0 ELSE a.nid END END AS nid FROM asg a, n")
def apply_log(spark, sf):
    a = assigned(spark, sf)
    log = U.change(a, U.merge_units(a, [2, 4, 6]), 1, "merge").unionByName(U.change(a, U.delete_units(a, [3]), 2, "delete"))
    return U.at_version(a, log, 2)


@query(f"WITH {_ASG}, n AS (SELECT nid FROM asg WHERE nid IN (2, 4, 6) GROUP BY nid ORDER BY count(*) DESC, nid LIMIT 1) SELECT sid, CASE WHEN a.nid IN (2, 4, 6) THEN n.nid ELSE a.nid END AS nid FROM asg a, n")
def undo_log(spark, sf):
    a = assigned(spark, sf)
    log = U.change(a, U.merge_units(a, [2, 4, 6]), 1, "merge").unionByName(U.change(a, U.delete_units(a, [3]), 2, "delete"))
    return U.at_version(a, log, 1)


@query(f"WITH {_ASG} SELECT greatest(max(nid) + 1, 1) AS single, least(min(nid) - 1, -1) AS multi FROM asg")
def next_unit_ids(spark, sf):
    return U.next_ids(assigned(spark, sf))


@query(f"WITH {_ASG} SELECT sid, CASE nid WHEN 5 THEN -1 ELSE -2 END::BIGINT AS nid FROM asg WHERE nid IN (5, 7)")
def label_multiunit(spark, sf):
    return U.label_multiunit(assigned(spark, sf), [5, 7]).select("sid", F.col("nid").cast("long").alias("nid"))


@query("WITH d AS (SELECT DISTINCT user_id AS nid FROM events WHERE user_id % 7 <> 3), n AS (SELECT nid, lead(nid) OVER (ORDER BY nid) AS next FROM d) SELECT nid, next FROM n WHERE next - nid <> 1")
def contiguous_ids(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("nid")).filter("nid % 7 <> 3")
    return U.id_gaps(e)


# ---------------------------------------------------------------- separation

_PROJ = f"""{PTS}, m AS (SELECT avg(x) FILTER (label = 0) AS ax, avg(y) FILTER (label = 0) AS ay, avg(x) FILTER (label = 1) AS bx, avg(y) FILTER (label = 1) AS by_ FROM pts),
proj AS (SELECT vec_id, label, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (power(bx - ax, 2) + power(by_ - ay, 2)) AS pos FROM pts, m WHERE label IN (0, 1)),
h AS (SELECT least(floor((pos + 4) / 0.9), 9)::INTEGER AS bin, count(*) FILTER (label = 0) AS na, count(*) FILTER (label = 1) AS nb FROM proj WHERE pos >= -4 AND pos <= 5 GROUP BY 1),
hist AS (SELECT g.bin, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT unnest(range(10))::INTEGER AS bin) g LEFT JOIN h USING (bin))"""


def _proj(spark, sf):
    return M.projection(points(spark, sf), "label", 0, 1, ["x", "y"])


@query(f"WITH {_PROJ} SELECT bin, na, nb FROM hist")
def cluster_hist(spark, sf):
    return M.two_histograms(_proj(spark, sf), "label", 0, 1, -4.0, 5.0, 10)


@query(f"""WITH {_PROJ}, t AS (SELECT sum(na) AS sa, sum(nb) AS sb, min(na) AS ma, min(nb) AS mb FROM hist),
p AS (SELECT (na / sa + CASE WHEN ma = 0 THEN 1e-10 ELSE 0 END) / (1 + CASE WHEN ma = 0 THEN 1e-9 ELSE 0 END) AS p, (nb / sb + CASE WHEN mb = 0 THEN 1e-10 ELSE 0 END) / (1 + CASE WHEN mb = 0 THEN 1e-9 ELSE 0 END) AS q FROM hist, t)
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM p""")
def js_divergence(spark, sf):
    return M.jensen_shannon(M.two_histograms(_proj(spark, sf), "label", 0, 1, -4.0, 5.0, 10)).select(rounded("js", 6).alias("js"))


@query(f"WITH {_PROJ} SELECT round(sum(least(na, nb)) / least(sum(na), sum(nb)), 6) AS oar FROM hist")
def overlap_area(spark, sf):
    return M.overlap_area(M.two_histograms(_proj(spark, sf), "label", 0, 1, -4.0, 5.0, 10)).select(rounded("oar", 6).alias("oar"))


@query(f"WITH {_PROJ} SELECT round(abs(avg(pos) FILTER (label = 0) - avg(pos) FILTER (label = 1)) / (3 * greatest(stddev_pop(pos) FILTER (label = 0), stddev_pop(pos) FILTER (label = 1))), 6) AS sep FROM proj")
def separation_1d(spark, sf):
    return M.separation_1d(_proj(spark, sf), "label", 0, 1).select(rounded("sep", 6).alias("sep"))


@query(f"WITH {PTS} SELECT round((36 / (8 * sqrt(3) - 9)) * power(avg(x * exp(-x * x / 2)), 2) + (24 / (16 * sqrt(3) - 27)) * power(avg(exp(-x * x / 2)) - sqrt(0.5), 2), 6) AS negentropy FROM pts")
def negentropy(spark, sf):
    return M.negentropy(points(spark, sf), "x").select(rounded("negentropy", 6).alias("negentropy"))


_NN = """p AS (SELECT vec_id, embedding FROM embeddings WHERE label = 0), o AS (SELECT vec_id, label, embedding FROM embeddings WHERE label IN (0, 1)),
d AS (SELECT p.vec_id AS id, o.label, list_sum(list_transform(range(1, 65), lambda k: power(p.embedding[k]::DOUBLE - o.embedding[k]::DOUBLE, 2))) AS d FROM p JOIN o ON p.vec_id <> o.vec_id),
nn AS (SELECT id, min(d) FILTER (label = 0) AS d_own, min(d) FILTER (label = 1) AS d_other FROM d GROUP BY id)"""


@query(f"WITH {_NN} SELECT id, (d_own <= d_other)::INTEGER AS same FROM nn")
def nn_membership(spark, sf):
    return M.nearest_membership(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 0, 1).select("id", "same")


@query(f"WITH {_NN} SELECT round(1 - (1 - avg((d_own <= d_other)::INTEGER)) / (1 - count(*) / (count(*) + (SELECT count(*) FROM embeddings WHERE label = 1))), 6) AS separation FROM nn")
def nd_separation(spark, sf):
    e = table(spark, sf, "embeddings")
    n = M.nearest_membership(e, "label", "vec_id", "embedding", 0, 1)
    return M.nd_separation(n, e.filter("label = 1").count()).select(rounded("separation", 6).alias("separation"))
