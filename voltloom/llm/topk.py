"""Operator 7: exact top-k inner-product search over an impact-ordered index.

Vectors become integers and are dealt to shards by descending norm.  In a shard
every component is quantised against the largest of its own vector, and the
postings (vector, dimension, quantised impact) are cut into segments by impact,
the next from a quarter of the last or less; components that quantise to zero
have none.  A block of queries goes through the segments from the largest impacts
down, summing ``query component * impact`` over the postings of vectors that
some query may still need.  What is still missing of a score is at most
``|query| * |residual|`` (Cauchy-Schwarz); the residual norms after each
segment are part of the index.  Before every segment the bounds give a score
that k vectors reach for certain; once few vectors could still reach it - or it
is proven that no other can - processing stops.  Possible members, ties
included, are rescored exactly in integers.

The index is stored once, a file per shard in the shared folder, and so are
the queries, a file per block of ``block_rows``; a manifest that Spark commits
lists the files of successful attempts with their largest norms.  A job takes
some shards, large norms first, and one block of queries and reads both by
itself: neither passes through the driver or a broadcast, and a task holds one
shard and one block.  The best scores of a job's earlier shards bound the later
ones; a shard whose norm bound no query can use is not read.  A job sends at
most k rows per query to the final ranking.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows with a null id; vectors are compared only
with vectors of equal length; a query meets every row but its own, so rows that
repeat an id or a vector are candidates and queries of their own; ties go to
the smaller vec_id; an empty table gives an empty result; components of any
finite size take part, and a returned score beyond 64 bits raises
OverflowError.  Only the named columns are read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .warc import filesystem

RESULT = "query_row long, query_id long, vec_id long, score long"
MANIFEST = "path string, dims int, rows long, norm double"
#: Quantised impacts, and the least of each segment; what quantises to zero has no posting.
LEVELS, SEGMENTS = 63, (32, 8, 1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them; doubles beyond 32 bits stay doubles."""
    most = np.abs(x).max(initial=0)
    for kind in (np.int8, np.int16, np.int32):
        if most <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


class ImpactIndex:
    """Posting segments of one shard of integer vectors (as float64, integers all)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.argsort(rows)
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.top = max(1.0, float(np.abs(vectors).max(initial=0)))
        unit = self.vectors / self.top
        # a posting is worth its level times its vector's step
        self.step = (np.abs(unit).max(1, initial=0) / LEVELS).astype(np.float32)
        level = np.rint(unit / np.maximum(self.step, np.finfo(np.float32).tiny)[:, None])
        self.segments, norms = [], [np.sqrt((unit**2).sum(1))]
        for least, over in zip(SEGMENTS, (LEVELS + 1, *SEGMENTS), strict=False):
            row, dim = np.nonzero((np.abs(level) >= least) & (np.abs(level) < over))
            impact = level[row, dim]
            self.segments.append((row, dim, impact.astype(np.int8)))
            unit[row, dim] -= impact * self.step[row]
            norms.append(np.sqrt((unit**2).sum(1)))
        self.norms = np.array(norms)

    def save(self) -> bytes:
        out, flat = io.BytesIO(), {}
        for k, (row, dim, impact) in enumerate(self.segments):
            flat |= {f"r{k}": _narrow(row), f"d{k}": _narrow(dim), f"i{k}": impact}
        norms = np.nextafter(self.norms.astype(np.float32), np.float32(np.inf))
        np.savez(out, ids=self.ids, rows=self.rows, vectors=_narrow(self.vectors), top=np.array(self.top), step=self.step, norms=norms, **flat)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ImpactIndex:
        self = cls.__new__(cls)
        z = np.load(io.BytesIO(data))
        self.ids, self.rows, self.vectors, self.top = z["ids"], z["rows"], z["vectors"].astype(np.float64), float(z["top"])
        self.step, self.norms = z["step"], z["norms"].astype(np.float64)
        self.segments = [(z[f"r{k}"].astype(np.int64), z[f"d{k}"].astype(np.int64), z[f"i{k}"]) for k in range(len(SEGMENTS))]
        self.touched = 0
        return self

    def add_segment(self, acc: np.ndarray, q: np.ndarray, k: int, needed: np.ndarray, most: int = 4_000_000) -> None:
        """Add a segment's postings of the ``needed`` vectors to the accumulators (vector, query).

        Postings that fill over an eighth of their vectors are summed as a
        matrix product, in blocks; few ones are summed one by one.
        """
        row, dim, impact = self.segments[k]
        if not needed.all():
            some = needed[row]
            row, dim, impact = row[some], dim[some], impact[some]
        self.touched += len(row)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(first[1:], len(row))
        thick = 8 * len(row) > len(first) * q.shape[0]
        size = max(1, most // (q.shape[0] + q.shape[1]) if thick else most // q.shape[1] // q.shape[0])
        for a in range(0, len(first), size):  # whole vectors, about ``most`` numbers at once
            at, starts = slice(first[a], ends[min(a + size, len(ends)) - 1]), first[a : a + size]
            of = row[starts]
            if thick:
                block = np.zeros((len(of), q.shape[0]), np.float32)
                block[np.repeat(np.arange(len(of)), ends[a : a + size] - starts), dim[at]] = impact[at]
                sums = block @ q
            else:
                sums = np.add.reduceat(q[dim[at]] * impact[at, None], starts - starts[0], axis=0)
            acc[of] += sums * self.step[of, None]

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int, known: np.ndarray, few: float = 0.002) -> np.ndarray:
        """(vector, query): whether the vector may be among the query's k best.

        ``own`` are the queries' rows, ``known`` scores that k vectors of other
        shards reach (-inf where there are none).
        """
        n, dims = self.vectors.shape
        size = np.maximum(np.abs(queries).max(1), 1.0)
        q = (queries / size[:, None]).astype(np.float32)
        length = np.sqrt(((queries / size[:, None]) ** 2).sum(1))
        # float32 sums stay within this much of the exact ones
        slack = (dims + len(self.segments) + 8) * 2.0**-22 * (length * float(self.norms[0].max(initial=0)) + 1e-3)
        known = known / (self.top * size) - slack
        at = np.minimum(np.searchsorted(self.rows, own), n - 1)
        mine = self.rows[at] == own
        acc = np.zeros((n, len(q)), np.float32)
        acc[at[mine], np.flatnonzero(mine)] = -np.inf
        starts = np.arange(0, n, max(1, n // 256))
        by_dim, member = np.ascontiguousarray(q.T), np.ones((n, len(q)), bool)
        for done in range(len(self.segments) + 1):
            if done:
                self.add_segment(acc, by_dim, done - 1, member.any(1))
            bound = (np.outer(self.norms[done], length) + slack).astype(np.float32)
            low = known
            if len(starts) >= k:
                # the best of k groups of vectors: scores that k vectors reach for certain; no longer needed ones never do
                sure = np.maximum.reduceat(np.where(member, acc - bound, -np.inf), starts, axis=0)
                low = np.maximum(low, np.partition(sure, len(starts) - k, axis=0)[len(starts) - k])
            member &= acc + bound >= low.astype(np.float32)[None, :]
            if member.sum() <= max(4 * k, few * n) * len(q):
                break
        member[at[mine], np.flatnonzero(mine)] = False
        return member

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products, in the narrowest numbers that hold them."""
        v = self.vectors[rows]
        most = self.top * float(np.abs(query).max(initial=0)) * len(query)
        if most < 2.0**53:  # every partial sum is an integer that a double holds
            return (v @ query).astype(np.int64)
        q = [int(x) for x in query]
        out = [sum(int(a) * b for a, b in zip(x, q, strict=True)) for x in v]
        return np.array(out, np.int64 if most < 2.0**62 else object)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _store(folder: str, rows_a_file: int, index: bool):
    """Write integer vectors of equal length into files, as an index or as they are; yields the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        held: dict[int, list] = {}

        def put(n):
            ids, rows, vectors = (np.concatenate(x) for x in zip(*held.pop(n), strict=True))
            name = f"{path}/{uuid.uuid4().hex}.npz"
            if index:
                data = ImpactIndex(ids, rows, vectors).save()
            else:
                out = io.BytesIO()
                np.savez(out, ids=ids, rows=rows, vectors=vectors)
                data = out.getvalue()
            with files.open_output_stream(name) as f:
                f.write(data)
            norm = float(np.sqrt((vectors**2).sum(1)).max())
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([norm])], names=["path", "dims", "rows", "norm"])

        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ids, rows = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            starts = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                some = np.flatnonzero(size == n)
                held.setdefault(n, []).append((ids[some], rows[some], flat[starts[some][:, None] + np.arange(n)]))
                if sum(len(x[0]) for x in held[n]) >= rows_a_file:
                    yield put(n)
        for n in list(held):
            yield put(n)

    return run


def _search(folder: str, k: int, at_once: int = 256):
    """Answers of one query block from some shards, a job a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)

        def read(path):
            with files.open_input_file(path) as f:
                return f.read()

        for b in batches:
            for block, shards in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.load(io.BytesIO(read(block)))
                ids, rows, vectors = z["ids"], z["rows"], z["vectors"]
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
                known = np.full(len(ids), -np.inf)
                length = np.sqrt((vectors**2).sum(1))
                for shard in shards:
                    if (length * shard["norm"] * (1 + 1e-9) < known).all():
                        break  # nor does any later shard, as norms descend
                    index = ImpactIndex.load(read(shard["path"]))
                    for a in range(0, len(ids), at_once):
                        member = index.candidates(vectors[a : a + at_once], rows[a : a + at_once], k, known[a : a + at_once])
                        for j in range(member.shape[1]):
                            at, q = np.flatnonzero(member[:, j]), a + j
                            held = found[q]
                            score = index.scores(at, vectors[q])
                            found[q] = best(np.concatenate([held[0], index.ids[at]]), np.concatenate([held[1], score]), k)
                            if len(found[q][0]) == k:
                                known[q] = float(found[q][1][-1])
                many = [len(x) for x, _ in found]
                score = np.concatenate([s for _, s in found]).tolist()
                if any(not -(1 << 63) <= s < 1 << 63 for s in score):
                    raise OverflowError("a score does not fit 64 bits")
                cols = [np.repeat(rows, many), np.repeat(ids, many), np.concatenate([x for x, _ in found]), np.array(score, np.int64)]
                yield pa.record_batch([pa.array(c) for c in cols], names=["query_row", "query_id", "vec_id", "score"])

    return run


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256, **more: Column) -> DataFrame:
    """(id, v) and more: components as floor(scale * x), integers in doubles, of rows that take part."""
    x = F.col(vector_col)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    out = df.filter(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)))
    scaled = lambda c: c.cast("double") * scale
    # beyond 2^52 every double is an integer; FLOOR would pass through a long
    whole = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < 2.0**52, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    return out.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), *[c.alias(n) for n, c in more.items()])


def build_index(rows: DataFrame, shard_rows: int = 8192) -> tuple[DataFrame, str]:
    """Store the index of ``rows(id, row, v)``; returns its manifest and folder."""
    return _stored(rows, shard_rows, True)


def _stored(rows: DataFrame, rows_a_file: int, index: bool) -> tuple[DataFrame, str]:
    folder = common.fresh_path(rows.sparkSession, "impact-index" if index else "query-blocks")
    files, path = filesystem(folder)
    files.create_dir(path)
    rows = rows.select("id", "row", "v")
    if index:  # shards by descending norm, so that whole shards can be left out
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        many = rows.count()
        parts = max(-(-many // rows_a_file), min(-(-many // 1024), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
        rows = rows.withColumn("n", norm).repartitionByRange(parts, F.desc("n"), "row").sortWithinPartitions(F.desc("n"), "row").select("id", "row", "v")
    return common.materialize(rows.mapInArrow(_store(folder, rows_a_file, index), MANIFEST), "vector-files"), folder


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = 8192, block_rows: int = 8192, shards_a_job: int = 16, broadcast_rows: int = 100_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``df`` that ``is_query`` holds for, the k best of the other rows."""
    spark = df.sparkSession
    rows = integer_vectors(df, id_col, vector_col, scale, query=F.coalesce(is_query, F.lit(False)), row=F.monotonically_increasing_id())
    rows = common.materialize(rows, "integer-vectors")
    index, folder = build_index(rows, shard_rows)
    asked = rows.filter("query")
    blocks, _ = _stored(asked.repartition(max(1, -(-asked.count() // block_rows)), "row"), block_rows, False)
    # a job: some shards and a block of queries of the same length
    shards, many = index.count(), blocks.count()
    groups = max(-(-shards // shards_a_job), min(shards, -(-4 * spark.sparkContext.defaultParallelism // max(1, many))), 1)
    grouped = index.groupBy("dims", F.pmod(F.xxhash64("path"), F.lit(groups)).alias("g")).agg(F.sort_array(F.collect_list(F.struct("norm", "path")), asc=False).alias("shards"))
    by = blocks.select("dims", F.col("path").alias("block"))
    jobs = grouped.join(F.broadcast(by) if many <= broadcast_rows else by, "dims").select("block", "shards")
    jobs = jobs.repartition(int(max(1, min(groups * many, 20_000))))
    out = jobs.mapInArrow(_search(folder, k), RESULT)
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)
