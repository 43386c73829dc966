"""One file written by many tasks, each at offsets planned beforehand.

On file systems the machines mount, tasks write into one temporary file of the
final size; attempts that run twice write the same bytes to the same place,
and the file gets its name when all have succeeded.  Other stores have no
writes in the middle: there tasks write an object per piece and one task joins
those of successful attempts in order, copying bytes only.  A failed write
leaves nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recordings import _open

PIECES = "at long, size long, name string"


@dataclass(frozen=True)
class Target:
    """Where a file is being written."""

    path: str
    tag: str

    @property
    def local(self) -> str | None:
        """The path on a mounted file system, if it is one."""
        return self.path.removeprefix("file://") if "://" not in self.path or self.path.startswith("file://") else None

    @property
    def temporary(self) -> str:
        return f"{self.local or _open(self.path)[1]}.parts-{self.tag}"

    def start(self, size: int) -> None:
        if self.local:
            with open(self.temporary, "wb") as f:
                f.truncate(size)
        else:
            _open(self.path)[0].create_dir(self.temporary)

    def put(self, at: int, data: bytes) -> str:
        """Write a piece from within a task; the name of its object, if it is one."""
        if self.local:
            fd = os.open(self.temporary, os.O_WRONLY)
            try:
                done = 0
                while done < len(data):
                    done += os.pwrite(fd, memoryview(data)[done:], at + done)
            finally:
                os.close(fd)
            return ""
        name = f"{self.temporary}/{at}-{uuid.uuid4().hex}"
        with _open(self.path)[0].open_output_stream(name) as f:
            f.write(data)
        return name

    def abort(self) -> None:
        if self.local:
            if os.path.exists(self.temporary):
                os.remove(self.temporary)
        else:
            _open(self.path)[0].delete_dir(self.temporary)


Pieces = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, bytes]]]


def write(rows: DataFrame, pieces: Pieces, path: str, size: int, whole: int | None = None) -> int:
    """Write what ``pieces`` makes of the batches of ``rows``, (offset, bytes), into a file of ``size`` bytes; what is not written is zero.

    Returns the bytes written.  ``whole`` is how many there must be.
    """
    return write_all([(rows, pieces)], path, size, whole=whole)


def write_all(parts: list[tuple[DataFrame, Pieces]], path: str, size: int, own: list[tuple[int, bytes]] = (), whole: int | None = None) -> int:
    """Write pieces of several tables, and a few small ones of the driver's ``own``, into one file."""
    target = Target(path, uuid.uuid4().hex)
    target.start(size)

    def writer(pieces: Pieces):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, data in pieces(batches):
                if at < 0 or at + len(data) > size:
                    raise ValueError(f"bytes {at} to {at + len(data)} of a file of {size}")
                yield pa.record_batch([pa.array([at]), pa.array([len(data)]), pa.array([target.put(at, data)])], names=["at", "size", "name"])

        return run

    try:
        listed = [(at, len(data), target.put(at, data)) for at, data in own]
        written = sum(n for _, n, _ in listed)
        for rows, pieces in parts:
            done = rows.mapInArrow(writer(pieces), PIECES)
            if target.local:
                written += done.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            else:
                some = [(r.at, r.size, r.name) for r in done.collect()]  # a row per piece
                written += sum(n for _, n, _ in some)
                listed += some
        listed.sort()
        if whole is not None and written != whole:
            raise ValueError(f"{written} bytes were written, not {whole}")
        if target.local:
            os.replace(target.temporary, target.local)
            return written

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, p = _open(path)
            for _ in batches:
                with store.open_output_stream(f"{target.temporary}/whole") as f:
                    end = 0
                    for at, n, name in listed:
                        _zeros(f, at - end)
                        with store.open_input_stream(name) as g:
                            while data := g.read(1 << 24):
                                f.write(data)
                        end = at + n
                    _zeros(f, size - end)
                store.move(f"{target.temporary}/whole", p)
                yield pa.record_batch([pa.array([size])], names=["n"])

        parts[0][0].sparkSession.range(1).coalesce(1).mapInArrow(join, "n long").collect()
        _open(path)[0].delete_dir(target.temporary)
        return written
    except BaseException:
        target.abort()
        raise


def _zeros(f, n: int) -> None:
    while n > 0:
        n -= f.write(bytes(min(n, 1 << 20))) or min(n, 1 << 20)
