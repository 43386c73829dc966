""".srf recordings: an index of records, and tasks that read their samples.

A file is a 2050-byte header, descriptor blocks, and tagged records up to its
end.  Records follow each other without a directory, so one task per file walks
their heads (``record_index``), jumping over the samples; the index is a table,
which can be kept as Parquet instead of a parse cache.  Samples are then read
by the records' offsets, a record a row, by as many tasks as one likes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .recordings import _open

# Fixed values of the file format.
HEADER_LEN = 2050
DESCRIPTOR_LEN = 2208
CONTINUOUS = struct.Struct("<qqhhii")
DIGITAL = struct.Struct("<qqhhi")
MESSAGE = struct.Struct("<cc6xqdi")
LAYOUT = struct.Struct("<c7xqBB2xiiBxhcxhh2xihhhhh2xi64Hh64hx255sx255s2xiiii880x")
DISPLAY = struct.Struct("<c7xqd")
STIMULUS = struct.Struct("<2sH")
STIMULUS_NAME = {100: 16, 110: 64}
STIMULUS_TABLE = {100: 0, 110: 50_000}
STIMULUS_PARAMETERS = 749
STIMULUS_SCREEN = struct.Struct("<6fHH")
TAGS = ("PS", "PC", "VD", "L", "MS", "MU", "D")
UNSUPPORTED = ("PE", "VA")
ZERO_LEVEL = 2048
#: Lowpass channel labels known to be saved wrongly, by electrode, and what they should be.
WRONG_LABELS = {("uMap54_2b", (20, 17, 14, 11, 81, 51, 22, 22, 24, 25)): (20, 17, 14, 11, 8, 5, 22, 2, 24, 25)}

INDEX = pa.schema(
    [
        ("file", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("t", pa.int64()), ("probe", pa.int32()), ("nsamples", pa.int32()),
        ("offset", pa.int64()), ("value", pa.int32()), ("days", pa.float64()), ("text", pa.string()), ("name", pa.string()),
        ("nchans", pa.int32()), ("rate", pa.int32()), ("shdelay", pa.int32()), ("extgain", pa.list_(pa.int32())), ("intgain", pa.int32()),
        ("adchans", pa.list_(pa.int32())), ("params", pa.list_(pa.float32())), ("screen", pa.list_(pa.float32())),
    ]
)
INDEX_DDL = (
    "file string, seq long, kind string, t long, probe int, nsamples int, offset long, value int, days double, text string, name string, "
    "nchans int, rate int, shdelay int, extgain array<int>, intgain int, adchans array<int>, params array<float>, screen array<float>"
)


class _Heads:
    """Small reads of a file, from blocks held in memory."""

    def __init__(self, f, block: int = 1 << 20):
        self.f, self.size, self.block, self.base, self.data = f, f.size(), block, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        if not self.base <= offset <= offset + n <= self.base + len(self.data):
            self.base, self.data = offset, self.f.read_at(min(max(n, self.block), self.size - offset), offset)
        out = self.data[offset - self.base : offset - self.base + n]
        if len(out) < n:
            raise ValueError(f"the file ends inside a record at {offset}")
        return out


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].replace(b"\xb5", b"u").decode("utf-8", "replace").rstrip()


def walk(f) -> Iterator[dict]:
    """Records of an open file in order, without their samples."""
    heads = _Heads(f)
    head = heads.at(0, HEADER_LEN)
    if head[:2] != b"\1\0" or _text(head[2:12]) != "UFF" or head[2048:2050] != b"\1\0":
        raise ValueError("not a .srf file")
    at = HEADER_LEN
    while at < heads.size and heads.at(at, 1) == b"\2":
        at += DESCRIPTOR_LEN
    while at < heads.size:
        tag = heads.at(at, 2).rstrip(b"\0").decode("latin-1")
        if tag in ("PS", "PC"):
            _, t, probe, _, _, n = CONTINUOUS.unpack(heads.at(at, CONTINUOUS.size))
            at += CONTINUOUS.size
            yield {"kind": tag, "t": t, "probe": probe, "nsamples": n, "offset": at}
            at += 2 * n
            if at > heads.size:
                raise ValueError("the file ends inside a record's samples")
        elif tag == "VD":
            _, t, value, _, _ = DIGITAL.unpack(heads.at(at, DIGITAL.size))
            yield {"kind": tag, "t": t, "value": value}
            at += DIGITAL.size
        elif tag in ("MS", "MU"):
            _, _, t, days, n = MESSAGE.unpack(heads.at(at, MESSAGE.size))
            yield {"kind": tag, "t": t, "days": days, "text": _text(heads.at(at + MESSAGE.size, n))}
            at += MESSAGE.size + n
        elif tag == "L":
            x = LAYOUT.unpack(heads.at(at, LAYOUT.size))
            n = x[9]
            yield {
                "kind": tag, "t": x[1], "probe": x[7], "nchans": n, "shdelay": x[16], "rate": x[17], "extgain": list(x[18 : 18 + n]), "intgain": x[82],
                "adchans": list(x[83 : 83 + n]), "text": _text(x[147]), "name": _text(x[148]),
            }
            at += LAYOUT.size
        elif tag == "D":
            _, t, days = DISPLAY.unpack(heads.at(at, DISPLAY.size))
            at += DISPLAY.size
            _, version = STIMULUS.unpack(heads.at(at, STIMULUS.size))
            if version not in STIMULUS_NAME:
                raise ValueError(f"stimulus header version {version}")
            at += STIMULUS.size
            name = heads.at(at, STIMULUS_NAME[version])
            at += len(name)
            params = struct.unpack(f"<{STIMULUS_PARAMETERS}f", heads.at(at, 4 * STIMULUS_PARAMETERS))
            at += 4 * STIMULUS_PARAMETERS
            table = heads.at(at, STIMULUS_TABLE[version])
            at += len(table)
            screen = STIMULUS_SCREEN.unpack(heads.at(at, STIMULUS_SCREEN.size))
            at += STIMULUS_SCREEN.size + 4
            yield {"kind": tag, "t": t, "days": days, "value": version, "name": _text(name), "text": _text(table), "params": [p if p == p else None for p in params], "screen": list(screen[:6])}
        elif tag in UNSUPPORTED:
            raise ValueError(f"records {tag} (at {at}) are not supported")
        else:
            raise ValueError(f"unexpected tag {tag!r} at {at}")
    if at > heads.size:
        raise ValueError("the file ends inside its last record")


def record_index(spark: SparkSession, paths: list[str], rows: int = 10_000) -> DataFrame:
    """A row per record of the files (S7, S8, S10, S14, S16, N7); one task per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, p = _open(path)
                held: list[dict] = []
                with store.open_input_file(p) as f:
                    for seq, r in enumerate(walk(f)):
                        held.append({"file": path, "seq": seq, **r})
                        if len(held) >= rows:
                            yield pa.RecordBatch.from_pylist(held, schema=INDEX)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=INDEX)

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, INDEX_DDL)


def layouts(index: DataFrame) -> DataFrame:
    """(file, probe, nchans, rate, extgain, intgain, adchans, text, name): the n-th layout of a file is probe n."""
    w = Window.partitionBy("file").orderBy("seq")
    rows = index.filter("kind = 'L'").withColumn("probe", (F.row_number().over(w) - 1).cast("int"))
    return rows.select("file", "probe", "nchans", "rate", "shdelay", "extgain", "intgain", "adchans", "text", "name")


def out_of_order(index: DataFrame) -> DataFrame:
    """Records whose time lies before that of the record of their kind before (S12); messages go by their date."""
    t = F.when(F.col("kind").isin("MS", "MU"), F.col("days")).otherwise(F.col("t").cast("double"))
    kind = F.when(F.col("kind").isin("MS", "MU"), F.lit("M")).otherwise(F.col("kind"))
    w = Window.partitionBy("file", "_k").orderBy("seq")
    return index.withColumn("_k", kind).withColumn("_t", t).withColumn("_b", F.lag("_t").over(w)).filter("_t < _b").drop("_k", "_t", "_b")


def start_datetime(index: DataFrame) -> DataFrame:
    """(file, datetime): the moment of t = 0, from the first message of the recorder, not of the user."""
    first = index.filter("kind = 'MS'").groupBy("file").agg(F.min_by(F.struct("days", "t"), "seq").alias("m"))
    us = F.unix_micros(F.lit("1899-12-30").cast("timestamp")) + F.rint(F.col("m.days") * 86_400e6).cast("long") - F.col("m.t")
    return first.select("file", F.timestamp_micros(us).alias("datetime"))


def digital(index: DataFrame) -> DataFrame:
    """(file, t, value) of the digital port."""
    return index.filter("kind = 'VD'").select("file", "t", "value")


def read_records(index: DataFrame, kind: str = "PS", broadcast_rows: int = 100_000, batch_bytes: int = 1 << 22) -> DataFrame:
    """(file, seq, t, probe, data): samples of continuous records less the zero level, a list per channel.

    Records are dealt by file and offset, so a task reads a stretch of a file
    through one open handle and passes on many records at once.
    """
    shapes = layouts(index).select("file", "probe", "nchans")
    shapes = F.broadcast(shapes) if shapes.count() <= broadcast_rows else shapes
    rows = index.filter(F.col("kind") == kind).join(shapes.withColumnRenamed("nchans", "_n"), ["file", "probe"])
    rows = rows.select("file", "seq", "t", "probe", "nsamples", "offset", F.col("_n").alias("nchans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, path, f = [], 0, None, None

        def out():
            heads = [pa.array([h[k] for h, _ in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32()))]
            flat = np.concatenate([x.ravel() for _, x in held]).astype(np.int32)
            chans = np.concatenate([[0], np.cumsum([x.shape[0] for _, x in held])]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.full(x.shape[0], x.shape[1]) for _, x in held]))]).astype(np.int32)
            data = pa.ListArray.from_arrays(pa.array(chans), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            held.clear()
            return pa.record_batch([*heads, data], names=["file", "seq", "t", "probe", "data"])

        try:
            for b in batches:
                for r in b.to_pylist():
                    if r["nsamples"] % r["nchans"]:
                        raise ValueError(f"{r['file']}: record {r['seq']} has no whole samples of {r['nchans']} channels")
                    if r["file"] != path:
                        if f is not None:
                            f.close()
                        path = r["file"]
                        store, p = _open(path)
                        f = store.open_input_file(p)
                    x = np.frombuffer(f.read_at(2 * r["nsamples"], r["offset"]), "<i2") - np.int16(ZERO_LEVEL)
                    held.append(((r["file"], r["seq"], r["t"], r["probe"]), x.reshape(r["nchans"], -1)))
                    size += x.nbytes
                    if size >= batch_bytes:
                        yield out()
                        size = 0
            if held:
                yield out()
        finally:
            if f is not None:
                f.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, "file string, seq long, t long, probe int, data array<array<int>>")


def stored_index(spark: SparkSession, paths: list[str], folder: str) -> DataFrame:
    """The record index of files, parsed once (S16): kept under each file's path, size and time of change.

    Only files that are new or have changed since are parsed; what was kept of
    a changed file no longer counts.  One writer at a time.
    """
    rows = []
    for p in paths:
        store, at = _open(p)
        info = store.get_file_info(at)
        rows.append((p, info.size, info.mtime_ns or 0))
    now = spark.createDataFrame(rows, "file string, _size long, _changed long")
    try:
        have = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        have = None
    keys = ["file", "_size", "_changed"]
    todo = now if have is None else now.join(have.select(*keys).distinct(), keys, "left_anti")
    if new := [r.file for r in todo.collect()]:  # a row per file asked for
        record_index(spark, new).join(F.broadcast(now), "file").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(F.broadcast(now), keys, "left_semi").drop("_size", "_changed")


def label_number(text) -> F.Column:
    """The channel in a probe description: the number after the first ``ch``."""
    return F.regexp_extract(text, r"ch([0-9]+)", 1).try_cast("int")


def lowpass_records(index: DataFrame) -> DataFrame:
    """(file, t, chans, adchans, nsamples, offsets): the single-channel lowpass records of a moment put together in probe order.

    Raises in the row (``assert_true``) where records of a file differ in length
    or a channel lacks some.
    """
    shapes = layouts(index).select("file", "probe", label_number("text").alias("chan"), F.col("adchans")[0].alias("adchan"))
    one = index.filter("kind = 'PC'").select("file", "t", "probe", "nsamples", "offset").join(shapes, ["file", "probe"])
    rows = one.groupBy("file", "t").agg(F.array_sort(F.collect_list(F.struct("probe", "chan", "adchan", "offset"))).alias("_r"), F.min("nsamples").alias("nsamples"), F.max("nsamples").alias("_most"))
    whole = one.groupBy("file").agg(F.countDistinct("probe").alias("_n"), F.min("nsamples").alias("_a"), F.max("nsamples").alias("_z"))
    names = layouts(index).groupBy("file").agg(F.min_by("name", "probe").alias("name"))
    out = rows.join(whole, "file").join(names, "file")
    sound = (F.size("_r") == F.col("_n")) & (F.col("_a") == F.col("_z"))
    chans = F.transform("_r", lambda r: r["chan"])
    for (name, wrong), right in WRONG_LABELS.items():
        chans = F.when((F.col("name") == name) & (chans == F.array(*map(F.lit, wrong))), F.array(*map(F.lit, right))).otherwise(chans)
    checked = F.when(F.assert_true(sound, F.lit("lowpass records differ in length or a channel lacks some")).isNull(), F.col("t"))
    return out.select(
        "file", checked.alias("t"), chans.alias("chans"), F.transform("_r", lambda r: r["adchan"]).alias("adchans"), "nsamples", F.transform("_r", lambda r: r["offset"]).alias("offsets")
    )


def stimulus_edges(index: DataFrame) -> DataFrame:
    """(file, display, t, value): digital values by the last display record at or before them; those before any are left out (K5)."""
    shown = index.filter("kind = 'D'").select("file", "t", F.lit(None).cast("int").alias("value"), F.col("t").alias("_d"), F.lit(0).alias("_o"))
    rows = digital(index).select("file", "t", "value", F.lit(None).cast("long").alias("_d"), F.lit(1).alias("_o")).unionByName(shown)
    w = Window.partitionBy("file").orderBy("t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("display", F.last("_d", ignorenulls=True).over(w)).filter("_o = 1 AND display IS NOT NULL").select("file", "display", "t", "value")


def text_headers(index: DataFrame) -> DataFrame:
    """(file, display, text): what the stimulus of each display record was (K6)."""
    return index.filter("kind = 'D' AND text <> ''").select("file", F.col("t").alias("display"), "text")
