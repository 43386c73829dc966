"""Arrays in .npy files and .npz archives as rows, read by ranges.

The driver reads an archive's directory and each array's header, no values.
Arrays of equal length are read side by side: a partition takes a range of
their first axis and, as members that are stored lie in the file as they are,
its bytes alone.  A deflated member has no place to start from, so archives
that hold one are streamed by one task, chunk by chunk, in bounded memory.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .recordings import _open


@dataclass(frozen=True)
class Array:
    """One array: where its values lie, and what they are; ``offset`` is None inside a deflated member."""

    path: str
    member: str | None
    offset: int | None
    shape: tuple[int, ...]
    dtype: str

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def real(self) -> bool:
        return np.dtype(self.dtype).kind == "f"

    @property
    def kind(self) -> str:
        one = "double" if self.real else "bigint"
        return one if len(self.shape) == 1 else f"array<{one}>"


def _header(f) -> tuple[tuple[int, ...], str, int]:
    """Shape, dtype and length of the header of an .npy stream; Python objects and column order are refused."""
    version = np.lib.format.read_magic(f)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"npy version {version}")
    shape, fortran, dtype = read(f)
    if dtype.kind not in "fiub" or fortran and len(shape) > 1:
        raise ValueError(f"arrays of {dtype}, column by column: {fortran}, are not read")
    return shape, dtype.str, f.tell()


def _local_start(f, info: zipfile.ZipInfo) -> int:
    """Where a stored member's bytes begin: behind its local header, whose lengths may differ from the directory's."""
    f.seek(info.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{info.filename}: no member at {info.header_offset}")
    return info.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def catalog(path: str) -> dict[str, Array]:
    """Arrays of an .npy file (by the name ``data``) or of an archive, by name; no values are read."""
    if path.endswith(".mat"):
        from . import matfiles

        return matfiles.catalog(path)
    store, p = _open(path)
    with store.open_input_file(p) as f:
        if path.endswith(".npy"):
            shape, dtype, n = _header(io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0)))
            return {"data": Array(path, None, n, shape, dtype)}
        out = {}
        with zipfile.ZipFile(f) as z:
            for info in z.infolist():
                name = info.filename.removesuffix(".npy")
                with z.open(info) as m:
                    shape, dtype, n = _header(m)
                start = _local_start(f, info) + n if info.compress_type == zipfile.ZIP_STORED else None
                out[name] = Array(path, info.filename, start, shape, dtype)
        return out


def values(a: Array) -> np.ndarray:
    """A small array whole, such as a scalar or a probe's positions."""
    store, p = _open(a.path)
    with store.open_input_file(p) as f:
        if a.offset is not None:
            raw = f.read_at(a.width * (a.shape[0] if a.shape else 1) * np.dtype(a.dtype).itemsize, a.offset)
            return np.frombuffer(raw, a.dtype).reshape(a.shape)
        with zipfile.ZipFile(f) as z, z.open(a.member) as m:
            return np.load(io.BytesIO(m.read()))


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ArrayReader(DataSourceReader):
    def __init__(self, arrays: dict[str, Array], rows: int):
        self.arrays, self.n = arrays, next(iter(arrays.values())).shape[0]
        # a chunk of all members is a few MB, whatever their width
        widest = max(8 * a.width for a in arrays.values())
        self.chunk = max(1, min(rows, (4 << 20) // widest))
        self.rows = max(rows, self.chunk)

    def partitions(self):
        if any(a.offset is None for a in self.arrays.values()):
            return [_Rows(0, self.n)]
        return [_Rows(a, min(a + self.rows, self.n)) for a in range(0, max(self.n, 1), self.rows)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        files, streams = [], {}
        try:
            for name, a in self.arrays.items():
                store, p = _open(a.path)
                f = store.open_input_file(p)
                files.append(f)
                if a.offset is None and a.member.startswith("@zlib:"):
                    from .matfiles import unpacked

                    streams[name] = unpacked(f, a.member).read
                elif a.offset is None:
                    m = zipfile.ZipFile(f).open(a.member)
                    _header(m)
                    streams[name] = m.read
                else:
                    f.seek(a.offset + part.first * a.width * np.dtype(a.dtype).itemsize)
                    streams[name] = f.read
            for lo in range(part.first, part.last, self.chunk):
                n = min(self.chunk, part.last - lo)
                cols = [pa.array(np.arange(lo, lo + n))]
                for name, a in self.arrays.items():
                    raw = streams[name](n * a.width * np.dtype(a.dtype).itemsize)
                    x = np.frombuffer(raw, a.dtype).astype(float if a.real else np.int64)
                    if len(x) != n * a.width:
                        raise ValueError(f"{a.path}: {name} ends too early")
                    flat = pa.array(x)
                    cols.append(flat if len(a.shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * a.width), flat))
                yield pa.record_batch(cols, names=["row", *self.arrays])
        finally:
            for f in files:
                f.close()


class ArraySource(DataSource):
    """``spark.read.format("arrays")``: rows of arrays of equal length; options ``paths`` (name=path|member, one a line) and ``rows`` a partition."""

    def __init__(self, options):
        super().__init__(options)
        self.arrays = {}
        known: dict[str, dict[str, Array]] = {}
        for line in options["paths"].splitlines():
            name, _, at = line.partition("=")
            path, _, member = at.rpartition("|")
            if member.startswith("@raw:"):  # values of a length and type at an offset of any file
                offset, n, dtype = member.split(":")[1:]
                self.arrays[name] = Array(path, None, int(offset), (int(n),), dtype)
                continue
            if path not in known:
                known[path] = catalog(path)
            if member not in known[path]:
                raise ValueError(f"{path} lacks {member}")
            self.arrays[name] = known[path][member]
        if len({a.shape[:1] for a in self.arrays.values()}) != 1 or not all(a.shape for a in self.arrays.values()):
            raise ValueError(f"arrays differ in length: { {n: a.shape for n, a in self.arrays.items()} }")

    @classmethod
    def name(cls):
        return "arrays"

    def schema(self):
        return ", ".join(["row bigint", *(f"`{n}` {a.kind}" for n, a in self.arrays.items())])

    def reader(self, schema):
        return ArrayReader(self.arrays, int(self.options.get("rows", 250_000)))


def rows(spark: SparkSession, arrays: dict[str, tuple[str, str]], rows_a_task: int = 250_000) -> DataFrame:
    """``row`` and a column per name, from (path, member); members beyond one axis are flat lists."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("arrays").option("paths", "\n".join(f"{n}={p}|{m}" for n, (p, m) in arrays.items())).option("rows", rows_a_task).load()
