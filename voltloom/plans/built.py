"""Registered queries that call the operators for streams, records, exports, checks, reload and shape features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, decompose, detection, extract, metrics, neighbours, relational, streams
from ..operators import signal as sig
from ..sources import exports, reload, surf
from ..streaming import windows
from ..session import materialized_stream, table
from .catalog import LNG, PTS, SIG, SPK, SQL, long_waves, points, q6, query, r6, rounded, signal, spikes, us

# ---------------------------------------------------------------- checks of units


@query(f"WITH {LNG} SELECT sid, chan, arg_min(ti, {{'v': v, 'ti': ti}}) AS imin, arg_min(ti, {{'v': -v, 'ti': ti}}) AS imax FROM lng GROUP BY sid, chan")
def peak_places(spark, sf):
    """First least and largest sample of every channel of a wave."""
    return checks.peak_places(long_waves(spark, sf), "sid", "chan", "ti", "v").withColumnRenamed("unit", "sid")


@query(f"""WITH {LNG}, p AS (SELECT sid, chan, arg_min(ti, {{'v': v, 'ti': ti}}) AS imin, arg_min(ti, {{'v': -v, 'ti': ti}}) AS imax FROM lng GROUP BY sid, chan)
SELECT sid, least(abs(imin - (sid % 8)), abs(imax - (sid % 8))) AS off FROM p WHERE chan = label_chan(sid) AND least(abs(imin - (sid % 8)), abs(imax - (sid % 8))) > 1""".replace("label_chan(sid)", "sid // 8 % 8"))
def misaligned_templates(spark, sf):
    """Waves without an extreme near the trigger sample of their main channel (M2)."""
    trigger = table(spark, sf, "embeddings").select(F.col("vec_id").alias("nid"), F.floor(F.floor(F.col("vec_id") / 8) % 8).alias("chan"), (F.col("vec_id") % 8).alias("at"))
    waves = long_waves(spark, sf).select(F.col("sid").alias("nid"), "chan", "ti", "v")
    return checks.misaligned_templates(waves, trigger).select(F.col("nid").alias("sid"), "off")


_LINE = """li AS (SELECT l_orderkey * 10 + l_linenumber AS sid, l_linenumber % 2 AS aligni, epoch_us(l_shipdate) AS t, l_quantity - 25 AS V0, 12 - l_quantity AS V1, l_linenumber * 40 AS dt FROM lineitem)"""


def _shapes(spark, sf):
    x = table(spark, sf, "lineitem")
    t = us("l_shipdate")
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sid"), (F.col("l_linenumber") % 2).alias("aligni"), t.alias("t"), (t - 500).alias("t0"), (t + 1000).alias("t1"),
        (F.col("l_quantity") - 25).alias("V0"), (12 - F.col("l_quantity")).alias("V1"), (F.col("l_linenumber") * 40).alias("dt"),
    )


@query(f"WITH {_LINE}, m AS (SELECT *, CASE WHEN aligni = 0 THEN V0 > V1 ELSE V1 > V0 END AS wrong FROM li) SELECT sid, CASE WHEN wrong THEN 1 - aligni ELSE aligni END AS aligni, t + CASE WHEN wrong THEN (CASE WHEN aligni = 0 THEN dt ELSE -dt END) ELSE 0 END AS t FROM m")
def align_to_min(spark, sf):
    """Spikes aligned to their minimum."""
    return checks.align_to(_shapes(spark, sf), "min").select("sid", "aligni", "t")


@query(f"WITH {_LINE}, m AS (SELECT *, CASE WHEN aligni = 0 THEN V0 < V1 ELSE V1 < V0 END AS wrong FROM li) SELECT sid, CASE WHEN wrong THEN 1 - aligni ELSE aligni END AS aligni, t - 500 + CASE WHEN wrong THEN (CASE WHEN aligni = 0 THEN dt ELSE -dt END) ELSE 0 END AS t0 FROM m")
def align_to_max(spark, sf):
    """Spikes aligned to their maximum, windows along with them."""
    return checks.align_to(_shapes(spark, sf), "max").select("sid", "aligni", "t0")


@query("""WITH a AS (SELECT o_orderkey AS sid, o_custkey % 9 AS nid FROM orders WHERE o_custkey % 9 <> 0), b AS (SELECT o_orderkey AS sid, CASE WHEN o_orderstatus = 'F' THEN 9 ELSE o_custkey % 9 END AS nid FROM orders)
(SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def inconsistent_members(spark, sf):
    """Spikes whose unit in the spike table is another than in the members' lists (M9)."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sid"), (F.col("o_custkey") % 9).alias("nid"), "o_orderstatus")
    return checks.inconsistent(o, o.select("sid", F.when(F.col("o_orderstatus") == "F", 9).otherwise(F.col("nid")).alias("nid")))


@query("SELECT s_suppkey AS nid, CASE WHEN s_nationkey IN (3, 4) THEN s_acctbal <= 0 ELSE s_acctbal > 0 END AS good FROM supplier")
def toggle_good(spark, sf):
    """Units whose mark is turned round (C15); here all units of two sites."""
    u = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nid"), (F.col("s_acctbal") > 0).alias("good"))
    return checks.set_good(u, [3, 4]).select(F.col("s_suppkey").alias("nid"), "good")


@query(f"""WITH {PTS}, m AS (SELECT label, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM pts GROUP BY label),
b AS (SELECT label, floor(sqrt(power((x - mx) / sx, 2) + power((y - my) / sy, 2)) / 0.25)::BIGINT AS bin, count(*) AS n FROM pts JOIN m USING (label) GROUP BY 1, 2),
r AS (SELECT *, n / (power((bin + 1) * 0.25, 2) - power(bin * 0.25, 2)) AS d, exp(-0.5 * power((bin + 0.5) * 0.25, 2)) AS g FROM b)
SELECT label, bin, n, {q6("d / sum(d) OVER (PARTITION BY label)")} AS density, {q6("g / sum(g) OVER (PARTITION BY label)")} AS normal FROM r""")
def density_histogram(spark, sf):
    """Density of a unit's points over scaled distance, and a Gaussian's."""
    return checks.density_histogram(points(spark, sf), "label", ["x", "y"]).select("label", "bin", "n", r6("density").alias("density"), r6("normal").alias("normal"))


@query(f"WITH {PTS} SELECT vec_id, {q6('x * cos(radians(30)) - y * sin(radians(30))')} AS x, {q6('x * sin(radians(30)) + y * cos(radians(30))')} AS y, {q6('z')} AS z FROM pts")
def rotated_points(spark, sf):
    """Points turned about an axis."""
    return checks.rotate(points(spark, sf), ("x", "y", "z"), 30.0).select("vec_id", *[r6(c).alias(c) for c in "xyz"])


# ---------------------------------------------------------------- streams


def _stream(car):
    return streams.Stream.highpass(1e6, filter=None, rate=1e6, car=car)


@query(f"WITH {SIG} SELECT chan, ti, {q6('v - avg(v) OVER (PARTITION BY ti)')} AS v FROM sig")
def stream_mean_reference(spark, sf):
    """A stream of raw rate without filter: all enabled channels less their mean."""
    return _stream("mean").read(signal(spark, sf).select("chan", "ti", "v"), 0, 1e12).select("chan", "ti", r6("v").alias("v"))


@query(f"WITH {SIG} SELECT chan, ti, {q6('v - median(v) OVER (PARTITION BY ti)')} AS v FROM sig WHERE ti < 200 AND ti >= 3")
def stream_time_range(spark, sf):
    """A time range of a stream, referenced by the median."""
    return _stream("median").read(signal(spark, sf).select("chan", "ti", "v"), 3, 200).select("chan", "ti", r6("v").alias("v"))


@query(f"WITH {SIG} SELECT chan, ti, floor(v)::INTEGER * 16 AS v FROM sig")
def to_16_bit(spark, sf):
    """Twelve-bit samples moved up."""
    return signal(spark, sf).select("chan", "ti", streams.to_16_bit(F.floor("v")).cast("int").alias("v"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(l_partkey, 50), 1500) AS a, least(greatest(l_partkey + l_quantity::BIGINT, least(greatest(l_partkey, 50), 1500)), 1500) AS b FROM lineitem")
def clamped_ranges(spark, sf):
    """Requested ranges cut to the limits of a file."""
    a, b = streams.clamp(F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity").cast("long"), F.lit(50).cast("long"), F.lit(1500).cast("long"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


@query("SELECT event_type, count(*) AS n, date_trunc('hour', ts) AS hour FROM events GROUP BY ALL")
def streamed_rates(spark, sf):
    """Windowed rates from a stream read to its end (2.15)."""
    e = table(spark, sf, "events").select("ts", "event_type")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*")  # a file or a folder of files
    counts = windows.rates(stream.withColumn("ts", F.col("ts").cast("timestamp")), size="1 hour", slide="1 hour")
    out = materialized_stream(counts.select(F.col("window.start").alias("hour"), "event_type", "n"), "complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


# ---------------------------------------------------------------- records and exports


def _index(spark, sf):
    """Events as records of files: purchases show a stimulus, the others are digital values."""
    kind = F.when(F.col("event_type") == "purchase", "D").otherwise("VD")
    return table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), us().alias("t"), kind.alias("kind"), F.floor("value").cast("int").alias("value"), F.lit(0.0).alias("days"), "props")


_IDX = "idx AS (SELECT user_id AS file, event_id AS seq, epoch_us(ts) AS t, CASE WHEN event_type = 'purchase' THEN 'D' ELSE 'VD' END AS kind, floor(value)::INTEGER AS value, props FROM events)"


@query(f"WITH {_IDX}, d AS (SELECT file, t AS display FROM idx WHERE kind = 'D') SELECT i.file, max(d.display) AS display, i.t, i.value FROM idx i JOIN d ON d.file = i.file AND d.display <= i.t WHERE i.kind = 'VD' GROUP BY i.file, i.seq, i.t, i.value")
def record_edges(spark, sf):
    """Digital values by the display record before them (K5)."""
    return surf.stimulus_edges(_index(spark, sf))


@query(f"WITH {_IDX}, w AS (SELECT file, seq, kind, t, lag(t) OVER (PARTITION BY file, kind ORDER BY seq) AS b FROM (SELECT file, seq, kind, t % 86400000000 AS t FROM idx)) SELECT file, seq, kind FROM w WHERE t < b")
def records_out_of_order(spark, sf):
    """Records earlier than the one of their kind before them."""
    by_day = _index(spark, sf).withColumn("t", F.col("t") % 86_400_000_000)  # the clock starts anew every day
    return surf.out_of_order(by_day).select("file", "seq", "kind")


@query(f"WITH {_IDX} SELECT file, t, value FROM idx WHERE kind = 'VD'")
def record_digital(spark, sf):
    """The digital port."""
    return surf.digital(_index(spark, sf))


@query(f"WITH {_IDX} SELECT file, t AS display, props AS text FROM idx WHERE kind = 'D' AND props <> ''")
def record_texts(spark, sf):
    """What each display showed (K6)."""
    return surf.text_headers(_index(spark, sf).withColumn("text", F.col("props")))


@query("SELECT c_custkey, TRY_CAST(nullif(regexp_extract(p, 'ch([0-9]+)', 1), '') AS INTEGER) AS chan FROM (SELECT c_custkey, replace(c_name, 'Customer#', 'LFP ch') AS p FROM customer)")
def label_channels(spark, sf):
    """The channel in a probe's description."""
    text = F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("LFP ch"))
    return table(spark, sf, "customer").select("c_custkey", surf.label_number(text).alias("chan"))


@query(f"WITH {SPK} SELECT t, chan, nid FROM spk")
def spike_list(spark, sf):
    """(t, chan, nid) in time order (K4)."""
    return exports.tschid(spikes(spark, sf))


@query("SELECT vec_id AS sid, list_transform(list_concat(embedding[11:14], embedding[27:30]), lambda x: x::DOUBLE) AS flat FROM embeddings".replace("AS flat", "AS f").replace("SELECT vec_id", "SELECT sid, round(f[1], 6) + 0.0 AS a, round(f[8], 6) + 0.0 AS b, len(f) AS n FROM (SELECT vec_id", 1) + ")")
def flat_waves(spark, sf):
    """Samples of the waves on common channels, one channel after the other (K8)."""
    chan = lambda c: F.transform(F.slice("embedding", c * 8 + 1, 8), lambda x: x.cast("double"))
    w = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sid"), F.sequence(F.lit(0), F.lit(7)).alias("chans"), F.array(*[chan(c) for c in range(8)]).alias("wave"))
    f = exports.spike_waves(w, [1, 3], 2, 6)
    return f.select("sid", r6(F.col("flat")[0]).alias("a"), r6(F.col("flat")[7]).alias("b"), F.size("flat").cast("long").alias("n"))


@query(f"WITH {SIG}, r AS (SELECT n_nationkey * 30 - 3 AS a, n_nationkey * 30 + n_regionkey * 4 + 3 AS b FROM nation) SELECT chan, ti, CASE WHEN EXISTS (SELECT 1 FROM r WHERE ti >= a AND ti < b) THEN 0.0 ELSE v END AS v FROM sig")
def zeroed_ranges(spark, sf):
    """Samples, zero in saturated ranges widened on both sides."""
    r = table(spark, sf, "nation").select((F.col("n_nationkey") * 30).cast("long").alias("ti0"), (F.col("n_nationkey") * 30 + F.col("n_regionkey") * 4).cast("long").alias("ti1"))
    return exports.without_ranges(signal(spark, sf).select("chan", "ti", "v"), r, 3)


# ---------------------------------------------------------------- reload


@query("""WITH w AS (SELECT o_orderkey AS sid, epoch_us(o_orderdate) // 3600000000 AS ti0, epoch_us(o_orderdate) // 3600000000 + 48 + o_custkey % 500 AS ti1 FROM orders),
d AS (SELECT min(ti0) AS first FROM w), e AS (SELECT n_nationkey AS k, 'f' || n_nationkey AS path, first + n_nationkey * 3000 AS e0, first + n_nationkey * 3000 + 2000 + n_regionkey * 250 AS e1 FROM nation, d),
p AS (SELECT *, greatest(ti0, e0) AS a, least(ti1, e1) AS b FROM w JOIN e ON ti0 < e1 AND e0 < ti1)
SELECT sid, path, a, b, place, 100 + 2 * (CASE WHEN place < 0 THEN 5 * (a - e0) ELSE place * (e1 - e0) + a - e0 END) AS byte0, 100 + 2 * (CASE WHEN place < 0 THEN 5 * (b - e0) ELSE place * (e1 - e0) + b - e0 END) AS byte1
FROM (SELECT *, unnest(CASE WHEN k % 2 = 0 THEN [-1] ELSE [2, 4] END) AS place FROM p)""")
def window_pieces(spark, sf):
    """Byte ranges of windows in the files of a track, over file edges and gaps."""
    t = F.floor(us("o_orderdate") / 3_600_000_000)
    w = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sid"), t.alias("ti0"), (t + 48 + F.col("o_custkey") % 500).alias("ti1"), F.array(F.lit(20), F.lit(40)).alias("chans"))
    first = w.agg(F.min("ti0")).first()[0] or 0
    k = F.col("n_nationkey")
    e0 = (F.lit(first) + k * 3000).cast("long")
    e = table(spark, sf, "nation").select(
        F.concat(F.lit("f"), k.cast("string")).alias("path"), e0.alias("e0"), (e0 + 2000 + F.col("n_regionkey") * 250).alias("e1"), F.lit(100).cast("long").alias("offset"), F.lit(5).alias("nchans"),
        (k % 2 == 0).alias("time_major"), F.lit(1.0).alias("gain"), F.lit(0).alias("zero"), F.array(*[F.lit(c) for c in (0, 10, 20, 30, 40)]).alias("echans"),
    )
    return reload.pieces(w, e, 1000).select("sid", "path", "a", "b", "place", "byte0", "byte1")


# ---------------------------------------------------------------- shape features

_HAAR = ["h0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a, []::DOUBLE[] AS d FROM embeddings)"]
for _k in range(6):
    _n = 32 >> _k
    _HAAR.append(
        f"h{_k + 1} AS (SELECT vec_id, label, list_transform(range(1, {_n + 1}), lambda k: (a[2 * k - 1] + a[2 * k]) * sqrt(0.5)) AS a, "
        f"list_concat(list_transform(range(1, {_n + 1}), lambda k: (a[2 * k - 1] - a[2 * k]) * sqrt(0.5)), d) AS d FROM h{_k})"
    )
_HAAR = ", ".join([*_HAAR, "haar AS (SELECT vec_id, label, list_concat(a, d) AS c FROM h6)"])
_CDF = "1 / (1 + 0.2316419 * abs(x)) AS t"
_KS = f"""{_HAAR}, x AS (SELECT label, i - 1 AS i, c[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM haar)),
t AS (SELECT *, {_CDF} FROM x), f AS (SELECT *, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS tail FROM t),
r AS (SELECT label, i, CASE WHEN x >= 0 THEN 1 - tail ELSE tail END AS f, row_number() OVER (PARTITION BY label, i ORDER BY x) AS k, count(*) OVER (PARTITION BY label, i) AS n FROM f),
ks AS (SELECT label, i, any_value(n) AS n, greatest(max(k / n - f), max(f - (k - 1) / n)) AS ks FROM r GROUP BY label, i)"""


def _haar(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", extract.haar(F.transform("embedding", lambda x: x.cast("double")), 64).alias("c"))


@query(f"WITH {_HAAR} SELECT vec_id, i - 1 AS i, {q6('c[i]')} AS c FROM (SELECT *, unnest(range(1, 65)) AS i FROM haar)")
def haar_coefficients(spark, sf):
    """Wavelet coefficients of every wave, coarsest first."""
    return _haar(spark, sf).select("vec_id", F.posexplode("c").alias("i", "c")).select("vec_id", F.col("i").cast("long").alias("i"), r6("c").alias("c"))


@query(f"WITH {_KS} SELECT label, i, n, {q6('ks')} AS ks FROM ks")
def haar_normality(spark, sf):
    """Distance of every coefficient from the standard normal, per unit."""
    return extract.normality(_haar(spark, sf), "label", "c").select("label", F.col("i").cast("long").alias("i"), "n", r6("ks").alias("ks"))


@query(f"WITH {_KS}, k AS (SELECT label, i, row_number() OVER (PARTITION BY label ORDER BY round(ks, 6) DESC, i) AS rank FROM ks) SELECT label, i, rank FROM k WHERE rank <= 5")
def haar_least_normal(spark, sf):
    """The five least normal coefficients of each unit."""
    ks = extract.normality(_haar(spark, sf), "label", "c").withColumn("ks", rounded("ks", 6))
    return extract.least_normal(ks, "label").select("label", F.col("i").cast("long").alias("i"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PTS}, v AS (SELECT list_value(x, y, z, 1.0::DOUBLE) AS v FROM pts), p AS (SELECT v, unnest(range(16)) AS k FROM v)
SELECT k::INTEGER AS k, round(sum(v[k // 4 + 1] * v[k % 4 + 1]), 4) + 0.0 AS x FROM p GROUP BY 1""")
def second_moments(spark, sf):
    """Sums of products that sparse components are fitted to."""
    v = points(spark, sf).select(F.array("x", "y", "z").alias("v"))
    return decompose.moments(v, "v").select("k", (rounded("x", 4) + 0.0).alias("x"))


@query()
def temporal_fits(spark, sf):
    """Two Gaussians at the extremes of every wave."""
    w = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sid"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    at = lambda f: (F.array_position("v", f("v")) - 1).cast("int")
    w = w.select("sid", "v", at(F.array_min).alias("peak0"), at(F.array_max).alias("peak1"), F.array_min("v").alias("V0"), F.array_max("v").alias("V1"))
    return extract.temporal_fits(w, 20.0)


@query()
def sparse_components(spark, sf):
    """Scores on five sparse components."""
    out = decompose.sparse_pca(table(spark, sf, "embeddings"), "embedding", 5)
    return out.select("vec_id", *[rounded(f"sc{k}", 4).alias(f"sc{k}") for k in range(5)])


# ---------------------------------------------------------------- long sequences by blocks


@query(SQL["isi"])
def isi_by_blocks(spark, sf):
    """W3 with a channel cut into days, so a long one is many tasks."""
    return metrics.isi(spikes(spark, sf), "chan", block=86_400_000_000).select("sid", "isi")


@query(SQL["sharpness"])
def sharpness_by_blocks(spark, sf):
    """W1 with channels cut into blocks of 64 samples."""
    x = detection.sharpness(signal(spark, sf), ["chan"], block=64)
    return x.select("chan", "ti", r6("v").alias("v"), r6("sharp").alias("sharp"))


@query(SQL["saturation_null_ranges"])
def saturated_by_blocks(spark, sf):
    """T12 with channels cut into blocks of 64 samples."""
    return sig.saturated_ranges(sig.saturation(signal(spark, sf), low=-19, high=80), ["chan"], 2, block=64)


@query(SQL["reload_sessions"])
def sessions_by_blocks(spark, sf):
    """W5 with units cut into days; a unit may hold a third of all spikes."""
    return relational.sessions(spikes(spark, sf), ["nid"], "t", 900_000_000, 3_600_000_000, ["t", "sid"], block=86_400_000_000).select("sid", "session", "piece")


@query(SQL["din_asof"])
def asof_by_blocks(spark, sf):
    """J13 with keys cut into days."""
    e = table(spark, sf, "events").select("event_id", "user_id", us().alias("t"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id"), us("o_orderdate").alias("rt")).agg(F.max("o_orderkey").alias("last_order"))
    return relational.asof(e, o, "t", "rt", ["last_order"], ["user_id"], block=86_400_000_000).filter("last_order IS NOT NULL").select("event_id", "last_order")


@query(f"WITH {SIG} SELECT chan, ti, row_number() OVER (PARTITION BY chan ORDER BY ti) - 1 AS dense FROM sig WHERE v > -15")
def squeezed_by_blocks(spark, sf):
    """Dense sample numbers over what is left of each channel (U3), counted by blocks."""
    x = signal(spark, sf).filter("v > -15")
    return sig.squeeze_gaps(x, ["chan"], block=64).select("chan", "ti", "dense")


@query("""WITH p AS (SELECT vec_id AS id, label, embedding AS e FROM embeddings WHERE label IN (2, 3)), d AS (
SELECT a.id, b.label = 3 AS other, list_sum(list_transform(list_zip(a.e, b.e), lambda x: power(x[1]::DOUBLE - x[2]::DOUBLE, 2))) AS d FROM p a JOIN p b ON a.id <> b.id WHERE a.label = 2)
SELECT id, round(min(d) FILTER (NOT other), 5) AS own, round(min(d) FILTER (other), 5) AS foreign_ FROM d GROUP BY id""")
def nearest_distances(spark, sf):
    """Squared distances to the nearest point of the own and of another unit, over k-d cells."""
    e = table(spark, sf, "embeddings").filter("label IN (2, 3)")
    p = e.select(F.col("vec_id").alias("id"), (F.col("label") == 3).alias("other"), F.col("embedding").cast("array<double>").alias("v"))
    return neighbours.nearest(p, 32).select("id", rounded("own", 5).alias("own"), rounded("foreign", 5).alias("foreign_"))
