"""Level-5 .mat files: numeric arrays read by ranges, and written.

A file is a row of elements; matrices hold elements of their own, and any of
them may be packed by zlib.  The catalog reads headers alone: of a packed
matrix it unpacks as much as the header needs.  A large vector is then read as
rows, by byte ranges or, where it is packed, as a stream in one task.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .recordings import _open

# Fixed values of the format: element types with their numbers, and classes of matrices.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}
MATRIX, PACKED = 14, 15
CELL, STRUCT, OBJECT, CHAR, SPARSE, DOUBLE, UINT8 = 1, 2, 3, 4, 5, 6, 9
LOGICAL = 0x0200


class _Inflated(io.RawIOBase):
    """The bytes that a packed element unpacks to, as a stream."""

    def __init__(self, f, offset: int, size: int, chunk: int = 1 << 16):
        self.f, self.at, self.end, self.chunk = f, offset, offset + size, chunk
        self.z, self.held = zlib.decompressobj(), b""

    def read(self, n: int = -1) -> bytes:
        out = [self.held]
        have = len(self.held)
        while (n < 0 or have < n) and not self.z.eof:
            if self.z.unconsumed_tail:
                piece = self.z.decompress(self.z.unconsumed_tail, 1 << 20)
            elif self.at < self.end:
                raw = self.f.read_at(min(self.chunk, self.end - self.at), self.at)
                self.at += len(raw)
                piece = self.z.decompress(raw, 1 << 20)
            else:
                break
            out.append(piece)
            have += len(piece)
        data = b"".join(out)
        n = len(data) if n < 0 else n
        self.held = data[n:]
        return data[:n]


class _Stored(io.RawIOBase):
    """Bytes of a file from an offset on, as a stream."""

    def __init__(self, f, offset: int):
        self.f, self.at = f, offset

    def read(self, n: int = -1) -> bytes:
        out = self.f.read_at(n, self.at)
        self.at += len(out)
        return out


def _tag(f, order: str) -> tuple[int, int, bytes | None]:
    """Type and size of the element that begins here; small ones hold their data in the tag."""
    raw = f.read(8)
    if len(raw) < 8:
        return 0, 0, None
    kind, size = struct.unpack(order + "II", raw)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, raw[4 : 4 + (kind >> 16)]
    return kind, size, None


def _element(f, order: str) -> tuple[int, bytes]:
    kind, size, data = _tag(f, order)
    if data is None:
        data = f.read(size)
        f.read(-size % 8)
    return kind, data


def _matrix(f, order: str) -> tuple[str, int, tuple[int, ...], int]:
    """Name, class, shape and flags of a matrix, up to its data."""
    _, flags = _element(f, order)
    word = struct.unpack(order + "I", flags[:4])[0]
    _, dims = _element(f, order)
    _, name = _element(f, order)
    return name.decode("latin-1"), word & 0xFF, tuple(np.frombuffer(dims, order + "i4").tolist()), word


def _parts(path: str) -> Iterator[tuple[object, str, int, int, bool]]:
    """(file, byte order, offset, size, packed) of each element of a file."""
    store, p = _open(path)
    with store.open_input_file(p) as f:
        head = f.read_at(min(128, f.size()), 0)
        if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
            raise ValueError(f"{path} is no level-5 .mat file")
        order, at = "<" if head[126:128] == b"IM" else ">", 128
        while at + 8 <= f.size():
            kind, size, small = _tag(_Stored(f, at), order)
            if kind in (MATRIX, PACKED):
                yield f, order, at + 8, size, kind == PACKED
            at += 8 + (0 if small is not None else size + (0 if kind == PACKED else -size % 8))


def catalog(path: str) -> dict[str, arrays.Array]:
    """Numeric arrays of a file by name; cells, structures and sparse matrices are not listed.

    Shapes are those of the file, column after column, so vectors are as they are.
    """
    out = {}
    for f, order, at, size, packed in _parts(path):
        s = _Inflated(f, at, size) if packed else _Stored(f, at)
        if packed:
            kind, _, _ = _tag(s, order)
            if kind != MATRIX:
                continue
        counted = _Counted(s)
        name, kind, shape, flags = _matrix(counted, order)
        if kind < DOUBLE and kind != CHAR or flags & 0x0800:
            continue  # no plain numbers, or complex ones
        type_, n, small = _tag(counted, order)
        taken = counted.count - (4 if small is not None else 0)  # a small element's data end its tag
        dtype = order + TYPES[type_]
        flat = (int(np.prod(shape, dtype=np.int64)),)
        out[name] = arrays.Array(path, f"@zlib:{at}:{size}:{8 + taken}" if packed else None, None if packed else at + taken, flat, dtype)
    return out


class _Counted:
    """A stream that counts what is read."""

    def __init__(self, f):
        self.f, self.count = f, 0

    def read(self, n: int) -> bytes:
        out = self.f.read(n)
        self.count += len(out)
        return out


def values(a: arrays.Array) -> np.ndarray:
    """A small array whole."""
    store, p = _open(a.path)
    with store.open_input_file(p) as f:
        size = a.shape[0] * np.dtype(a.dtype).itemsize
        return np.frombuffer(f.read_at(size, a.offset) if a.offset is not None else unpacked(f, a.member).read(size), a.dtype)


def unpacked(f, member: str) -> _Inflated:
    """The stream of a packed array's values."""
    at, size, skip = map(int, member.split(":")[1:])
    s = _Inflated(f, at, size)
    s.read(skip)
    return s


def cells(path: str, name: str) -> list[np.ndarray]:
    """Numeric members of a small cell array."""
    for f, order, at, size, packed in _parts(path):
        s = _Inflated(f, at, size) if packed else _Stored(f, at)
        if packed:
            _tag(s, order)
        found, kind, shape, _ = _matrix(s, order)
        if found == name and kind == CELL:
            out = []
            for _ in range(int(np.prod(shape))):
                _, body = _element(s, order)
                inner = io.BytesIO(body)
                _matrix(inner, order)
                type_, data = _element(inner, order)
                out.append(np.frombuffer(data, order + TYPES[type_]))
            return out
    raise ValueError(f"{path} has no cell array {name}")


def simulated(spark: SparkSession, path: str, uv_per_ad: float = 1e7 / 2**15 / 2000, rows_a_task: int = 250_000) -> tuple[DataFrame, DataFrame, float]:
    """A single simulated channel (S20): samples (chan, ti, v in uV), ground truth (sid, ti, nid), and its rate in Hz.

    ``data`` are mV, ``samplingInterval`` ms; samples take the steps of a
    16-bit converter and must fit it.
    """
    have = catalog(path)
    rate = float(round(1000 / float(values(have["samplingInterval"])[0])))
    start = values(have["startData"]) if "startData" in have else np.zeros(1)
    if start.any():
        raise ValueError(f"{path} starts at sample {start[0]}")
    ad = F.rint(F.col("data") * 1000 / uv_per_ad)
    fits = F.assert_true((ad > -(2**15)) & (ad < 2**15 - 1), F.lit("samples do not fit 16 bits"))
    samples = arrays.rows(spark, {"data": (path, "data")}, rows_a_task).select(F.lit(0).alias("chan"), F.col("row").alias("ti"), F.when(fits.isNull(), ad * uv_per_ad).alias("v"))
    times, units = cells(path, "spike_times")[0], cells(path, "spike_class")[0]
    n = have["data"].shape[0]
    if len(times) != len(units) or len(times) and times.max() >= n:
        raise ValueError(f"{path}: spike times and classes differ, or lie behind the data")
    rows = [(k, int(t), int(u)) for k, (t, u) in enumerate(zip(times, units, strict=True))]
    return samples, spark.createDataFrame(rows, "sid long, ti long, nid long"), rate


def _written(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)


def matrix(name: str, x: np.ndarray) -> bytes:
    """One matrix of doubles or logical values as an element."""
    x = np.atleast_2d(x)
    logical = x.dtype == bool
    flags = struct.pack("<II", (UINT8 if logical else DOUBLE) | (LOGICAL if logical else 0), 0)
    body = _written(6, flags) + _written(5, np.array(x.shape, "<i4").tobytes()) + _written(1, name.encode())
    body += _written(2 if logical else 9, x.astype("u1" if logical else "<f8").tobytes("F"))
    return struct.pack("<II", MATRIX, len(body)) + body


def write(path: str, variables: dict[str, np.ndarray], packed: bool = False) -> None:
    """A level-5 .mat file of small numeric arrays."""
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    body = [matrix(n, np.asarray(x)) for n, x in variables.items()]
    if packed:
        body = [struct.pack("<II", PACKED, len(z)) + z for z in map(zlib.compress, body)]
    store, p = _open(path)
    with store.open_output_stream(p) as f:
        f.write(head + b"".join(body))


def write_channel_map(path: str, sites: list[tuple[int, float, float]], rate: float) -> None:
    """The channel map of a spike sorter (K13): sites (channel, x, y) in the order of the file; depth counts from the bottom."""
    n, xy = len(sites), np.array([s[1:] for s in sites], float).reshape(-1, 2)
    column = lambda v: np.asarray(v, float).reshape(-1, 1)
    write(path, {
        "connected": np.ones((n, 1), bool), "chanMap": np.arange(1.0, n + 1), "chanMap0ind": np.arange(float(n)), "xcoords": column(xy[:, 0]),
        "ycoords": column(xy[:, 1].max(initial=0) - xy[:, 1]), "kcoords": np.ones((n, 1)), "fs": np.array([[float(rate)]]),
    })
