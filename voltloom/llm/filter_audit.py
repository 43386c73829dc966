"""Operator 11: how filters interact, audited over all their orders.

One pass over the texts gives each document a mask of the filters that it
fails and a digest; the least id of every digest, counted map-side, adds the
filter for copies.  The first failing step of every mask in every order stands
in a table computed once (32 masks by 120 orders for five filters), so a batch
of masks becomes an array of steps by one lookup, and ``np.bincount`` adds up
removals by part, order and step - of all documents, of good and of toxic
ones.  Tasks send these partial arrays, zeros left out, and Spark sums them.
What the other columns say follows from the sums: a failing document that
earlier filters leave is removed, so the redundant are the failing less the
removed.

Defined results: a null text is an empty one, a null part the empty string; a
document without an id neither fails the copy filter nor makes others fail;
rows that repeat an id are documents each, none a copy of the other; a
label counts where any row of the id has it; a null label is none; an
empty table gives an empty result.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS) + 1
GRID = len(ORDERS) * STEPS
#: Cells of a part: removals of all, of good, of toxic documents; failing; failing one filter only.
CELLS = 3 * GRID + 2 * len(FILTERS)
COPY = 1 << FILTERS.index("E")

REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def first_failures() -> np.ndarray:
    """(mask, order): the step (from 1) of the first failing filter, 0 if none fails."""
    return np.array([[next((k + 1 for k, f in enumerate(o) if mask >> FILTERS.index(f) & 1), 0) for o in ORDERS] for mask in range(1 << len(FILTERS))], np.uint8)


def text_mask(text: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()  # of bytes: ASCII white space only
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * n_chars) << 2
        | (len(text.translate(None, b"#$%&*|")) < len(text)) << 3
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        mask, digest = [], []
        for t in b.column(2):
            text = t.as_py() or ""
            raw = text.encode()
            mask.append(text_mask(raw, len(text)))
            digest.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.record_batch([b.column(0), b.column(1), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, part, mask): the filters that each document fails."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    rows = common.materialize(rows.mapInArrow(_masks, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    firsts = common.materialize(firsts, "audit-copies")
    small = F.broadcast(firsts) if firsts.count() <= broadcast_rows else firsts.hint("merge")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(COPY)).otherwise(0)
    return rows.join(small, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def _count(limit: int = 256):
    """Partial arrays of a task, by part; sent when ``limit`` parts are held, and at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = first_failures().astype(np.int64) + np.arange(len(ORDERS)) * STEPS
        bits = 1 << np.arange(len(FILTERS))
        held: dict[str, np.ndarray] = {}

        def send():
            for part, sums in held.items():
                at = np.flatnonzero(sums)
                yield pa.record_batch([pa.array([part] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["part", "cell", "n"])
            held.clear()

        for b in batches:
            coded = b.column(0).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            mask = b.column(1).to_numpy()
            marks = [None, *(b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3))]
            for name in set(names) - held.keys():
                if len(held) >= limit:
                    yield from send()
                held[name] = np.zeros(CELLS, np.int64)
            for k, name in enumerate(names):
                if name not in held:  # sent meanwhile
                    held[name] = np.zeros(CELLS, np.int64)
                mine = code == k
                for g, only in enumerate(marks):
                    m = mask[mine if only is None else mine & only]
                    held[name][g * GRID : (g + 1) * GRID] += np.bincount(table[m].ravel(), minlength=GRID)
                m = mask[mine]
                fails = (m[:, None] & bits) > 0
                held[name][3 * GRID :] += np.concatenate([fails.sum(0), (m[:, None] == bits).sum(0)])
        yield from send()

    return run


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums = np.zeros(CELLS, np.int64)
            for c in cells:
                sums[c["cell"]] = c["n"]
            removed, good, toxic = sums[: 3 * GRID].reshape(3, len(ORDERS), STEPS)
            fails, alone = sums[3 * GRID :].reshape(2, -1)
            kept = removed.sum(1, keepdims=True) - removed[:, 1:].cumsum(1)
            shapley = np.bincount(at.ravel(), removed[:, 1:].ravel(), len(FILTERS)).astype(np.int64)
            cols = [kept, removed[:, 1:], fails[at] - removed[:, 1:], alone[at], good[:, 1:], toxic[:, 1:], shapley[at]]
            n = at.size
            yield pa.record_batch(
                [pa.array([part] * n), pa.array(np.repeat(ORDERS, STEPS - 1).tolist()), pa.array(np.tile(np.arange(1, STEPS, dtype=np.int32), len(ORDERS))), *[pa.array(c.ravel()) for c in cols]],
                names=[c.split()[0] for c in REPORT.split(", ")],
            )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for every part, order of the filters and step (columns of ``REPORT``)."""
    masks = failure_masks(docs, id_col, text_col, part_col)
    marks = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = masks.join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    cells = marked.mapInArrow(_count(), "part string, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    # at most CELLS sums a part
    return cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).mapInArrow(_report, REPORT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, common.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
