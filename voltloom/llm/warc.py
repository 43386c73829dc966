"""Operator 2: WARC archives, written and read back in splits by boundary chains.

Writing: every task writes its rows as WARC/1.1 records into files of its own,
under names no other attempt uses, and returns the names; only names returned
by successful attempts are in the manifest, so files of lost attempts are never
read.  Of records with equal payloads the one with the smallest page id is a
response, the others revisit it.

Reading: a file is cut into splits at arbitrary offsets.  Each task looks for
record magic in its split, and for every candidate with a well-formed header
computes the offset of its successor; chains inside the split are shortened to
the first offset beyond it.  Pointer jumping from the start of each file then
keeps only the offsets that real records reach, so magic inside payloads is
rejected, and tasks read the records from the kept entries of their splits.

Defined results: null html is an empty payload; a null url leaves out the
target URI; rows with a null page id are written too, and revisit equal
payloads of any known page id; repeated rows with the smallest page id are all
responses; an empty table writes no record and returns no row.  Only the named
columns are read.  Headers have any length.  A damaged record ends its file's
chain, so what follows it is unreachable: reading raises ValueError where a
chain does not end at the end of its file or holds other than the records its
manifest row lists (``damaged="keep"`` returns what is reachable instead).  A
payload that fails its digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1."
AHEAD = 1 << 16
_HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
#: What may still become a header when more bytes are read.
_OPEN = re.compile(rb"WARC/1\.(?:[01](?:\r(?:\n(?:[!-9;-~]+:[^\r\n]*\r\n)*(?:[!-9;-~]*|[!-9;-~]+:[^\r\n]*\r?|\r))?)?)?\Z")
_LENGTH = re.compile(rb"(?:\A|\r\n)content-length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str):
    """The file system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URI_SAFE)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI_SAFE = "!#$&'()*+,/:;=?@[]~-._"


def record_id(page_id) -> str:
    return uuid.UUID(bytes=hashlib.md5(f"page {page_id}".encode()).digest(), version=3).urn


def _info(date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _write(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        out, name, size, many = None, "", 0, 0

        def done():
            out.close()
            return pa.record_batch([pa.array([f"{path}/{name}"]), pa.array([size], pa.int64()), pa.array([many], pa.int64())], names=["path", "size", "records"])

        for b in batches:
            html = b.column(2)
            for row, (i, u, digest, first) in enumerate(zip(*[b.column(k).to_pylist() for k in (0, 1, 3, 4)], strict=True)):
                if out is None:
                    name, many = f"{uuid.uuid4().hex}.warc", 0
                    out = files.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)
                    head = _info(date)
                    out.write(head)
                    size = len(head)
                payload = (html[row].as_py() or "").encode()
                kind = "response" if first is None or i == first else "revisit"
                x = record(kind, i, u, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first, date)
                out.write(x)
                size, many = size + len(x), many + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_revisit: int = 0, file_bytes: int = 1 << 30, date: str = "2020-01-01T00:00:00Z", broadcast_rows: int = 200_000,
) -> DataFrame:
    """Write a record per row into ``folder``; returns the manifest (path, size, records)."""
    spark = pages.sparkSession
    folder = folder or common.fresh_path(spark, "warc")
    files, path = filesystem(folder)
    files.create_dir(path)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    found = rows.filter(F.octet_length("html") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = common.materialize(found.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "equal-payloads")
    # A long list of repeated payloads is joined by sort and merge, where the
    # runtime splits the partition of a payload that very many pages share.
    found = F.broadcast(found) if found.count() <= broadcast_rows else found.hint("merge")
    rows = rows.join(found, "digest", "left").select("page_id", "url", "html", "digest", "first")
    written = rows.mapInArrow(_write(folder, date, file_bytes), "path string, size long, records long")
    return common.materialize(written, "warc-manifest")


# ---------------------------------------------------------------- reading


class _Window:
    """Bytes of a file from ``base`` on, read further as headers and blocks need them."""

    def __init__(self, f, size: int, base: int, most: int):
        self.f, self.size, self.base = f, size, base
        self.data = f.read_at(max(min(most, size - base), 0), base)

    def more(self, stop: int) -> None:
        """Hold the bytes up to ``stop`` or the end of the file."""
        end = self.base + len(self.data)
        if min(stop, self.size) > end:
            self.data += self.f.read_at(min(stop, self.size) - end, end)

    def forget(self, at: int) -> None:
        self.data, self.base = self.data[at - self.base :], at

    def header(self, at: int) -> tuple[int, int] | None:
        """(end of the header, length of the block) of a well-formed record header at ``at``."""
        ahead = AHEAD
        self.more(at + 16)
        while True:
            m = _HEADER.match(self.data, at - self.base)
            if m is not None:
                n = _LENGTH.search(b"\r\n" + m[1])
                return (self.base + m.end(), int(n[1])) if n else None
            end = self.base + len(self.data)
            if end >= self.size or not _OPEN.match(self.data, at - self.base):
                return None
            self.more(end + ahead)
            ahead *= 4

    def bytes(self, start: int, stop: int) -> bytes:
        self.more(stop)
        return self.data[start - self.base : stop - self.base]


LINKS = "path string, at long, next long, many long"


def _candidates(folder: str, split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        for b in batches:
            for path, start, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
                succ: dict[int, tuple[int, int]] = {}
                with files.open_input_file(path) as f:
                    size = min(size, f.size())
                    stop = min(start + split_bytes, size)
                    w = _Window(f, size, start, max(stop + AHEAD - start, 0))
                    at = w.data.find(MAGIC)
                    while 0 <= at < stop - start:
                        h = w.header(start + at)
                        if h and sum(h) + 4 <= size:
                            succ[start + at] = sum(h) + 4, 1
                        at = w.data.find(MAGIC, at + 1)
                for o in sorted(succ, reverse=True):  # later ones first: chains shorten to beyond the split
                    to, many = succ[o]
                    if to in succ:
                        succ[o] = succ[to][0], many + succ[to][1]
                cols = [pa.array([path] * len(succ), pa.string()), pa.array(list(succ), pa.int64()), *[pa.array([v[k] for v in succ.values()], pa.int64()) for k in (0, 1)]]
                yield pa.record_batch(cols, names=["path", "at", "next", "many"])

    return run


def reachable(links: DataFrame) -> DataFrame:
    """(path, at): offsets reached from offset 0 of each file over ``links(path, at, next)``, by pointer jumping."""
    seen = links.filter("at = 0").select("path", "at")
    jumps, before = links.select("path", "at", "next"), seen.count()
    while True:
        to = seen.join(jumps, ["path", "at"]).select("path", F.col("next").alias("at"))
        seen = common.materialize(seen.unionByName(to.join(links.select("path", "at"), ["path", "at"], "left_semi")).distinct(), "warc-seen")
        now = seen.count()
        if now == before:
            return seen
        before = now
        twice = jumps.alias("a").join(jumps.select("path", F.col("at").alias("next"), F.col("next").alias("then")), ["path", "next"], "left")
        jumps = common.materialize(twice.select("path", "at", F.coalesce("then", "next").alias("next")), "warc-jumps")


RECORDS = "path string, at long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _read(folder: str, split_bytes: int, keep_payload: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def parse(path, at, head: bytes, block: bytes) -> tuple | None:
        field = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:] if x)}
        kind = field.get("warc-type")
        if kind not in ("response", "revisit"):
            return None
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = field["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
            raise ValueError(f"{path} at {at}: the payload does not match its digest")
        number = lambda k: int(field[k]) if k in field else None
        url = unquote(field["warc-target-uri"]) if "warc-target-uri" in field else None
        return path, at, kind, number("x-page-id"), url, size, digest, number("x-refers-to-page-id"), payload if keep_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        for b in batches:
            for path, entry in zip(*[c.to_pylist() for c in b.columns], strict=True):
                stop = (entry // split_bytes + 1) * split_bytes
                rows, held = [], 0
                with files.open_input_file(path) as f:
                    size, at = f.size(), entry
                    w = _Window(f, size, entry, max(stop - entry, 0) + AHEAD)
                    while at < min(stop, size):
                        h = w.header(at)
                        if h is None or sum(h) + 4 > size:
                            break
                        w.more(sum(h))
                        r = parse(path, at, w.bytes(at, h[0]), w.bytes(h[0], sum(h)))
                        if r:
                            rows.append(r)
                            held += h[1] if keep_payload else 100
                        at = sum(h) + 4
                        if at - w.base > split_bytes:
                            w.forget(min(at, w.base + len(w.data)))
                        if held > 32_000_000:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_archives(manifest: DataFrame, folder: str | None = None, split_bytes: int = 16 << 20, keep_payload: bool = True, damaged: str = "raise") -> DataFrame:
    """Records of the files in ``manifest(path, size[, records])``, found by boundary chains."""
    spark = manifest.sparkSession
    folder = folder or common.shared_dir(spark)
    pieces = F.greatest(F.lit(0), F.ceil(F.col("size") / split_bytes) - 1)
    many = manifest.agg(F.sum(pieces + 1)).first()[0] or 1
    parts = int(min(max(many, 1), 20_000))
    splits = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long"))).alias("k"), "size")
    splits = splits.select("path", (F.col("k") * split_bytes).alias("start"), "size").repartition(parts, "path", "start")
    links = common.materialize(splits.mapInArrow(_candidates(folder, split_bytes), LINKS), "warc-links")
    entries = reachable(links)
    if damaged == "raise":
        _whole(manifest, entries.join(links, ["path", "at"]))
    return entries.repartition(parts, "path", "at").mapInArrow(_read(folder, split_bytes, keep_payload), RECORDS)


def _whole(manifest: DataFrame, chains: DataFrame) -> None:
    """Raise unless every file's chain ends with the file and holds the records listed (beside its warcinfo)."""
    ends = chains.groupBy("path").agg(F.max("next").alias("end"), F.sum("many").alias("found"))
    listed = F.col("records") + 1 if "records" in manifest.columns else F.col("found")
    bad = manifest.join(ends, "path", "left").filter((F.col("size") > 0) & ~(F.col("end").eqNullSafe(F.col("size")) & F.col("found").eqNullSafe(listed)))
    bad = [r.path for r in bad.select("path").limit(5).collect()]
    if bad:
        raise ValueError(f"record chains break off in {', '.join(bad)}")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = read_archives(write_archives(pages), keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
