"""Operator 4: drop lines that many documents share.

Lines are normalised, keyed by a 128-bit hash and exploded once, one row per
row and key with the positions of the key's lines.  A map-side-combined count
leaves the keys of at least ``min_docs`` rows, and of those the distinct
documents are counted; joined back, the shared keys give each document the
positions to drop, and the text is put together again from the positions that
stay.  Only hashes and positions are shuffled on the way to the counts, never
lines.

A document is a doc_id: rows that repeat one are one document.  The holder
that keeps a shared line is the document with the largest doc_id, in all its
rows.  Rows without a doc_id count as one document, smaller than any other.

Defined results: a null or empty text is one empty line, which is never
dropped; a text whose lines are all dropped becomes empty; repeated rows each
get a row; an empty table gives an empty result.  Other columns pass
unchanged; columns named n_lines, n_dropped or as the kept text are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SMALLEST = -(1 << 63)


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, keys = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            doc, tag, digests, first, spots = [], [], [], [], []
            for row, (d, t) in enumerate(zip(ids, keys, strict=True)):
                where: dict[bytes, list[int]] = {}
                # bytes.lower and bytes.strip touch ASCII letters and white space only
                for k, line in enumerate((texts[row].as_py() or "").encode().lower().split(b"\n")):
                    line = line.strip()
                    if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
                        where.setdefault(xxhash.xxh3_128_digest(line), []).append(k)
                for h, at in where.items():
                    doc.append(d)
                    tag.append(t)
                    digests.append(h)
                    first.append(at)
                    spots.append(len(at))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum(np.array(spots, np.int64))]).astype(np.int32)
            flat = np.array([p for at in first for p in at], np.int32)
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["_d", "_t", "_h1", "_h2", "_at"],
            )

    return run


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """One row per document and line key: id, text tag, key halves, positions of its lines."""
    return docs.select(
        F.col(text_col), F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST)), F.xxhash64(F.col(text_col))
    ).toDF("text", "_d", "_t").mapInArrow(_explode(min_chars), "_d long, _t long, _h1 long, _h2 long, _at array<int>")


def _without(text: pd.Series, drop: pd.Series) -> pd.Series:
    def kept(t, at):
        if at is None or not len(at):
            return t
        gone = set(at.tolist())
        return "\n".join([line for k, line in enumerate(t.split("\n")) if k not in gone])

    return pd.Series([kept(t, at) for t, at in zip(text, drop, strict=True)], dtype=object)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept_col: str = "kept",
    min_chars: int = 40,
    min_docs: int = 5,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """``docs`` with n_lines, n_dropped and the text without shared lines in ``kept_col``."""
    d, t, drop = common.fresh_names(docs, "d", "t", "drop", also=("n_lines", "n_dropped", kept_col))
    lines = common.materialize(line_keys(docs, id_col, text_col, min_chars), "lines")
    often = lines.groupBy("_h1", "_h2").count().filter(F.col("count") >= min_docs).select("_h1", "_h2")
    often = common.materialize(often, "frequent-lines")
    # Few keys are sent to every task. Many are joined by sort and merge,
    # where the runtime splits the partitions of keys that very many documents hold.
    small = often.count() <= broadcast_rows
    often = F.broadcast(often) if small else often.hint("merge")
    held = common.materialize(lines.join(often, ["_h1", "_h2"]), "frequent-line-places")
    shared = (
        held.select("_h1", "_h2", "_d")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_keep"))
        .filter(F.col("_n") >= min_docs)
        .drop("_n")
    )
    shared = F.broadcast(common.materialize(shared, "shared-lines")) if small else shared.hint("merge")
    drops = (
        held.join(shared, ["_h1", "_h2"])
        .filter(F.col("_d") < F.col("_keep"))
        .groupBy(F.col("_d").alias(d), F.col("_t").alias(t))
        .agg(F.array_distinct(F.flatten(F.collect_list("_at"))).alias(drop))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(d, F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST))).withColumn(t, F.xxhash64(F.col(text_col)))
    # Documents that lose lines are few: sent to every task if counted so, texts stay where they are.
    drops = common.materialize(drops, "dropped-lines")
    out = keyed.join(F.broadcast(drops) if drops.count() <= broadcast_rows else drops.hint("merge"), [d, t], "left")
    return (
        out.withColumn("n_lines", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))
        .withColumn("n_dropped", F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).cast("long"))
        .withColumn(kept_col, F.pandas_udf(_without, "string")(text, F.col(drop)))
        .drop(d, t, drop)
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
