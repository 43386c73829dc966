"""Operator 6: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits.  The bits are dealt into partitions, correlated
bits together; partition ``i`` gets a threshold ``t_i`` with
``sum(t_i + 1) = max_bits + 1``, so two fingerprints that differ in at most
``max_bits`` bits differ in at most ``t_i`` bits of some partition.  A dynamic
programme picks the thresholds (-1 leaves a partition out) that make probes
and estimated candidates cheapest; the estimate comes from a bounded sample
and steers cost only, never results.  Every distinct fingerprint is filed
under its partition's bits, once for each choice of ``t_i`` masked bits;
fingerprints that meet in a bucket are compared exactly.

Copies collapse to one distinct fingerprint before any probing.  A bucket
above ``bucket_cap`` members is not compared: its members are filed again
under more of their bits (``max_bits + 1`` blocks of the bits still free, one
of which must agree), level by level, until every bucket is small; when
``log2(bucket_cap)`` bits are free a bucket cannot exceed the cap.  A bucket
yields a spanning star per linked class, not its pairs.

Defined results: a null or empty text, or one of white space only, has no
words and fingerprint zero, and is linked like any other; repeated rows each
get a row; a component whose doc_ids are all null has a null id; an empty
table gives an empty result; other columns but the text pass unchanged, and
columns named fingerprint or component_id are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lowering A-Z: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by spaces, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    norm = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(norm, seed)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length)[: len(words) - size + 1].tolist()
    return np.array([h(norm[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.view(np.uint8).reshape(n, 8).astype(np.int64) + np.arange(8) * 256
    ones = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits((2 * ones > n).ravel(), bitorder="little").tobytes(), "little")


def simhash_column(text: Column | str, shingle: int = 3) -> Column:
    """Column: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(s: pd.Series) -> pd.Series:
        out = np.array([fingerprint(shingle_hashes(words_of(t), shingle)) for t in s], np.uint64)
        return pd.Series(out.view(np.int64))

    return fp(text)


# ---------------------------------------------------------------- plan


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal 64 bits into ``m`` groups, the most correlated bits together."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    dev = bits - bits.mean(0)
    std = np.sqrt((dev**2).mean(0)) + 1e-9
    corr = np.abs(dev.T @ dev / len(bits)) / np.outer(std, std)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, groups))) // (m - k)
        rest = sorted(left)
        seed = max(rest, key=lambda b: corr[b, rest].max())
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            b = max(sorted(left), key=lambda x: corr[x, group].mean())
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, n: int, max_bits: int, most_parts: int = 8) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, for ``n`` distinct fingerprints."""
    sample = np.ascontiguousarray(sample, np.uint64)
    if len(sample) < 2:
        sample = np.array([0, (1 << 64) - 1], np.uint64)
    best, chosen = None, None
    for m in range(1, min(most_parts, max_bits + 1) + 1):
        groups = bit_groups(sample, m)
        masks = [np.uint64(sum(1 << b for b in g)) for g in groups]
        costs = []
        for g, mask in zip(groups, masks, strict=True):
            part = sample & mask
            d = np.bitwise_count(part[:, None] ^ part[None, :])[np.triu_indices(len(part), 1)]
            # at least what independent even bits would give, where the sample is too small to tell
            near = np.cumsum(np.bincount(d, minlength=len(g) + 1)) / len(d)
            even = np.cumsum([comb(len(g), k) for k in range(len(g) + 1)]) / 2.0 ** len(g)
            near = np.maximum(near, even)
            costs.append([0.0] + [4.0 * n * comb(len(g), t) + n * (n - 1) / 2 * near[min(t, len(g))] for t in range(max_bits + 1)])
        need = max_bits + 1
        table = {0: (0.0, [])}
        for c in costs:
            step: dict = {}
            for used, (cost, ts) in table.items():
                for t in range(-1, max_bits + 1):
                    u = used + t + 1
                    if u <= need and (u not in step or cost + c[t + 1] < step[u][0]):
                        step[u] = (cost + c[t + 1], [*ts, t])
            table = step
        cost, ts = table[need]
        if best is None or cost < best:
            best, chosen = cost, list(zip(groups, ts, strict=True))
    return [(g, t) for g, t in chosen if t >= 0]


def probe_masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The bits that each filing of a fingerprint keeps."""
    return [sum(1 << b for b in g if b not in gone) for g, t in parts for gone in combinations(g, t)]


# ---------------------------------------------------------------- probe and verify


def _bucket(mask: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Bucket number of (mask, masked bits); a clash only costs a comparison."""
    x = (value ^ (mask * np.uint64(0xBF58476D1CE4E5B9))) * _MULT
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB) ^ mask


def _file_first(masks: list[int]):
    ms = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for m in ms:
                mask = np.full(len(fp), m)
                yield _filed(mask, fp)

    return run


def _file_again(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for m in np.unique(old):
                some = fp[old == m]
                free = [k for k in range(64) if not int(m) >> k & 1]
                for k in range(max_bits + 1):
                    more = sum(1 << x for x in free[k :: max_bits + 1])
                    if more:
                        yield _filed(np.full(len(some), m | np.uint64(more)), some)

    return run


def _filed(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    cols = [_bucket(mask, fp & mask), mask, fp]
    return pa.record_batch([pa.array(c.view(np.int64)) for c in cols], names=["b", "m", "fp"])


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least member of each class) after the links a-b."""
    while True:
        x, y = root[a], root[b]
        live = x != y
        if not live.any():
            return root
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _links(bucket: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the links inside each run of equal ``bucket`` numbers.

    Links join classes as they are found, none is kept; a run that is one
    class already is left alone.
    """
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([edge, [len(bucket)]]))
    root = np.arange(len(fp))
    shift, reach = 1, int(size.max()) if len(size) else 0
    place = np.arange(len(bucket)) - np.repeat(edge, size)
    room = np.repeat(size, size) - place  # members from here to the end of the run
    small = np.flatnonzero(room > 1)
    while shift < reach and len(small):
        small = small[room[small] > shift]
        hit = small[np.bitwise_count(fp[small] ^ fp[small + shift]) <= max_bits]
        hit = hit[root[hit] != root[hit + shift]]
        if len(hit):
            root = _join(root, hit, hit + shift)
            one = np.minimum.reduceat(root, edge) == np.maximum.reduceat(root, edge)
            small = small[~np.repeat(one, size)[small]]
        shift += 1
    at = np.flatnonzero(root != np.arange(len(fp)))
    return fp[at], fp[root[at]]


def _verify(max_bits: int, rows: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(b, f):
            u, v = _links(b, f, max_bits)
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held_b = np.concatenate([held_b, batch.column(0).to_numpy(zero_copy_only=False)])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(held_b) < rows:
                continue
            cut = int(np.searchsorted(held_b, held_b[-1]))  # the last run may go on
            if cut:
                yield out(held_b[:cut], held_f[:cut])
                held_b, held_f = held_b[cut:], held_f[cut:]
        if len(held_b):
            yield out(held_b, held_f)

    return run


FILED = "b long, m long, fp long"


def near_links(fps: DataFrame, max_bits: int = 3, bucket_cap: int = 4096, plan_sample: int = 2000, broadcast_rows: int = 200_000) -> DataFrame:
    """(u, v): stars that span every class of distinct fingerprints ``fps(fp)`` linked at ``max_bits``."""
    spark = fps.sparkSession
    n = fps.count()
    sample = [r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(plan_sample).collect()]
    masks = probe_masks(plan(np.array(sample, np.int64).view(np.uint64), max(n, 2), max_bits))
    filed = fps.mapInArrow(_file_first(masks), FILED)
    found = []
    while True:
        big = common.materialize(filed.groupBy("b").count().filter(F.col("count") > bucket_cap).select("b"), "big-buckets")
        many = big.count()
        if not many:
            found.append(filed)
            break
        big = F.broadcast(big) if many <= broadcast_rows else big
        found.append(filed.join(big, "b", "left_anti"))
        again = filed.join(big, "b", "left_semi").select("b", "m", "fp").mapInArrow(_file_again(max_bits), FILED)
        filed = common.materialize(again, "filed-again")
    links = None
    for f in found:
        part = f.select("b", "fp").repartition("b").sortWithinPartitions("b").mapInArrow(_verify(max_bits), "u long, v long")
        links = part if links is None else links.unionByName(part)
    return links


def classes(fps: DataFrame, max_bits: int = 3, bucket_cap: int = 4096) -> DataFrame:
    """(node, root) of the distinct fingerprints ``fps(fp)`` that another one lies within ``max_bits`` of."""
    return components(near_links(fps, max_bits, bucket_cap))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, bucket_cap: int = 4096, most_heavy: int = 10_000
) -> DataFrame:
    """One row per document: its columns but the text, ``fingerprint`` (hex) and ``component_id``.

    Fingerprints of more than one in ``most_heavy`` documents - so at most that
    many - take their component from a broadcast, all others by a join.
    """
    key, label, light = common.fresh_names(docs, "fp", "component", "light", also=("fingerprint", "component_id"))
    rows = docs.withColumn(key, simhash_column(F.col(text_col), shingle)).drop(text_col, "component_id", "fingerprint")
    rows = common.materialize(rows, "fingerprints")
    nodes = common.materialize(rows.groupBy(F.col(key).alias("fp")).agg(F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_n")), "distinct-fingerprints")
    roots = classes(nodes.select("fp"), max_bits, bucket_cap)
    joined = roots.join(nodes, roots.node == nodes.fp)
    least = joined.groupBy("root").agg(F.min("_id").alias("_least"))
    linked = joined.select("fp", "root").join(least, "root").select("fp", "_least")
    labels = nodes.join(linked, "fp", "left").select(F.col("fp").alias(key), F.coalesce("_least", "_id").alias(label), "_n")
    labels = common.materialize(labels, "components")
    many = labels.agg(F.sum("_n")).first()[0] or 0
    heavy = (F.col("_n") > 1) & (F.col("_n") * most_heavy > many)
    first = rows.join(F.broadcast(labels.filter(heavy).select(key, label, F.lit(False).alias(light))), key, "left")
    rest = first.filter(F.col(light).isNull()).drop(label, light).join(labels.filter(~heavy).select(key, label), key, "left")
    out = first.filter(F.col(light).isNotNull()).drop(light).unionByName(rest)
    return out.withColumns({"fingerprint": F.lower(F.lpad(F.hex(key), 16, "0")), "component_id": F.col(label)}).drop(key, label)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


# ---------------------------------------------------------------- similar texts

#: Min-hashes of a text, those of one filing, and bits kept of each for comparison.
HASHES, BAND, KEPT_BITS = 128, 5, 2
_BANDS = HASHES // BAND
_rng = np.random.default_rng(0x5EED)
_FACTOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_LOW_BITS = np.uint64(0x5555555555555555)
_WORDS = HASHES * KEPT_BITS // 64


def min_hashes(hashes: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """The least value of every hash function over a set of 64-bit hashes."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), at_once):
        y = x[k : k + at_once][None, :] * _FACTOR + _SHIFT
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(12)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def most_different(similarity: float, deviations: float = 3.5) -> int:
    """Kept min-hashes in which texts of a similarity differ at most, but for one pair in thousands."""
    p = (1 - similarity) * (1 - 0.5**KEPT_BITS)
    return int(HASHES * p + deviations * (HASHES * p * (1 - p)) ** 0.5)


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many kept min-hashes two sketches (last axis: words) differ."""
    d = x ^ y
    return np.bitwise_count((d | (d >> np.uint64(1))) & _LOW_BITS).sum(axis=-1, dtype=np.int16)


SKETCH = "hash long, fp long, size int, bands binary, " + ", ".join(f"s{k} long" for k in range(_WORDS))
_SKETCH_COLUMNS = [f"s{k}" for k in range(_WORDS)]


def _sketch(shingle: int, fp_shingle: int = 3):
    """Text hash, fingerprint, number of distinct shingles, a bucket number per filing, and the sketch."""

    def sketch(s: pd.Series) -> pd.DataFrame:
        n = len(s)
        name, fp, size, least = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int32), np.zeros((n, HASHES), np.uint32)
        for k, t in enumerate(s):
            words = words_of(t)
            h = np.unique(shingle_hashes(words, shingle))
            name[k], size[k], least[k] = xxhash.xxh3_64_intdigest(b" ".join(words)), len(h), min_hashes(h)
            fp[k] = fingerprint(shingle_hashes(words, fp_shingle))
        bands = np.zeros((n, _BANDS), np.uint64)
        for k in range(_BANDS * BAND):
            bands[:, k // BAND] = (bands[:, k // BAND] ^ least[:, k]) * _MULT
        bands = (bands ^ (bands >> np.uint64(29))) * _MULT + np.arange(_BANDS, dtype=np.uint64)
        kept = (least & np.uint32(3)).astype(np.uint64).reshape(n, _WORDS, 32) << np.arange(0, 64, 2, dtype=np.uint64)
        kept = np.bitwise_or.reduce(kept, axis=2).view(np.int64)
        out = {"hash": name.view(np.int64), "fp": fp.view(np.int64), "size": size, "bands": [x.tobytes() for x in bands]}
        return pd.DataFrame(out | {c: kept[:, k] for k, c in enumerate(_SKETCH_COLUMNS)})

    return F.pandas_udf(sketch, SKETCH)


FILED_TEXTS = "b long, node long, size int, " + ", ".join(f"{c} long" for c in _SKETCH_COLUMNS)


def _file_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and filing."""
    for batch in batches:
        if batch.num_rows:
            bands = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(-1, _BANDS)
            for k in range(_BANDS):
                cols = [pa.array(bands[:, k].copy()), batch.column(0), batch.column(1), *batch.columns[3:]]
                yield pa.record_batch(cols, names=["b", "node", "size", *_SKETCH_COLUMNS])


def _whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = 50_000, most_bytes: int = 48 << 20) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    count = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)])
        count, size = count + b.num_rows, size + b.nbytes
        if (count >= rows or size >= most_bytes) and held[-1][0][-1] != held[0][0][0]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            edge = np.flatnonzero(cols[0][1:] != cols[0][:-1])[-1] + 1
            yield [x[:edge] for x in cols]
            held, count, size = [[x[edge:] for x in cols]], len(cols[0]) - edge, 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _may_be_alike(similarity: float, few: int = 32, at_once: int = 128):
    """Stars over the classes of a cell's members whose sketches and sizes allow ``similarity``.

    A cell of two blocks compares members of different blocks alone.
    """
    most = most_different(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, node, size, blk, cross, *sketch in _whole_buckets(batches):
            sk = np.stack([x.view(np.uint64) for x in sketch], axis=1)
            size = size.astype(np.float64)

            def near(i, j):
                ok = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9
                ok &= ~cross[i] | (blk[i] != blk[j])
                return ok & (_differences(sk[i], sk[j]) <= most)

            edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            many = np.diff(np.concatenate([edge, [len(b)]]))
            root = np.arange(len(b))
            room = np.repeat(many, many) - (root - np.repeat(edge, many))
            small = np.flatnonzero((np.repeat(many, many) <= few) & (room > 1))
            for shift in range(1, few):
                small = small[room[small] > shift]
                if not len(small):
                    break
                i = small[root[small] != root[small + shift]]
                i = i[near(i, i + shift)]
                root = _join(root, i, i + shift)
            for a, m in zip(edge[many > few].tolist(), many[many > few].tolist(), strict=True):
                own = np.arange(m)
                for k in range(0, m, at_once):
                    x, y = np.nonzero(near(np.arange(a + k, a + min(m, k + at_once))[:, None], np.arange(a + k, a + m)[None, :]))
                    own = _join(own, k + x, k + y)
                root[a : a + m] = a + own
            at = np.flatnonzero(root != np.arange(len(b)))
            yield pa.record_batch([pa.array(node[root[at]]), pa.array(node[at])], names=["u", "v"])

    return run


def _alike(similarity: float):
    """Links that span the classes of a cell's members of at least ``similarity``, verified on whole shingle sets.

    Every two members of different ``root`` whose sketches and sizes allow it
    are compared exactly, but for those that links found before have joined.
    """
    most = most_different(similarity)

    def links(node, size, root, blk, cross, sets, sk):
        flat = np.frombuffer(b"".join(sets), np.uint64)
        start = np.concatenate([[0], np.cumsum(size)])
        names, ids = np.unique(flat, return_inverse=True)
        ids, mine = ids.astype(np.int32), np.zeros(len(names), bool)
        _, first, at = np.unique(root, return_index=True, return_inverse=True)
        root = first[at]
        for i in range(len(node) - 1):
            j = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            j = j[(np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9) & (size[j] > 0)]
            j = j[~cross[j] | (blk[j] != blk[i])]
            j = j[_differences(sk[j], sk[i]) <= most]
            if not len(j):
                continue
            many = size[j]
            skip = np.cumsum(many) - many
            own = ids[start[i] : start[i + 1]]
            mine[own] = True
            both = np.add.reduceat(mine[ids[np.repeat(start[j] - skip, many) + np.arange(many.sum())]], skip, dtype=np.int64)
            mine[own] = False
            j = j[both / (size[i] + many - both) >= similarity]
            if len(j):
                yield from ((node[i], node[j[k]]) for k in np.unique(root[j], return_index=True)[1])
                root = _join(root, np.full(len(j), i), j)
                if (root == root[0]).all():
                    return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, node, size, root, blk, cross, sets, *sketch in _whole_buckets(batches):
            sk = np.stack([x.view(np.uint64) for x in sketch], axis=1)
            size = size.astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])).tolist()
            found: list = []
            for a, z in zip(edge, [*edge[1:], len(c)], strict=True):
                found += links(*(x[a:z] for x in (node, size, root, blk, cross, sets, sk)))
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.record_batch([pa.array(u.copy()), pa.array(v.copy())], names=["u", "v"])

    return run


def _shingle_set(shingle: int):
    """Sorted distinct shingle hashes of a text."""

    def hashes(s: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(words_of(t), shingle)).tobytes() for t in s], dtype=object)

    return F.pandas_udf(hashes, "binary")


def _cells(rows: DataFrame, group: str, other, columns: list) -> DataFrame:
    """Rows dealt to the cells of their block with the ``other`` blocks of their group, sorted by cell."""
    rows = rows.withColumn("other", F.explode(other))
    lo, hi = F.least("blk", "other"), F.greatest("blk", "other")
    rows = rows.select(F.xxhash64(group, lo, hi).alias("c"), "node", "size", *columns[:-1], "blk", (lo != hi).alias("cross"), *columns[-1], *_SKETCH_COLUMNS)
    return rows.repartition("c").sortWithinPartitions("c", "node")


def _all_blocks():
    return F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)


def _fingerprint_stars(nodes: DataFrame, max_bits: int, bucket_cap: int) -> DataFrame:
    """(u, v): stars over texts ``nodes(node, fp)`` whose fingerprints are of one class, by the operator's own steps."""
    fps = common.materialize(nodes.select("fp").distinct(), "distinct-fingerprints")
    roots = common.materialize(classes(fps, max_bits, bucket_cap), "fingerprint-classes")
    named = nodes.select("node", "fp").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "u")
    stars = common.materialize(named.join(least, "root").filter("node <> u").select("u", F.col("node").alias("v")), "fingerprint-stars")
    common.forget(fps, roots)
    return stars


def _linked(met: DataFrame, stars: DataFrame, nodes: DataFrame, sets_of, similarity: float, cap: int, most_shingles: int, broadcast_rows: int) -> DataFrame | None:
    """(node, root) of the components of pairs of ``similarity`` or more among the texts that met; None without any.

    Texts of one fingerprint class (``stars``), and texts whose sketches may be
    alike in some bucket, are of one cloud; no pair leaves a bucket as a row.  The shingle sets of a cloud then meet once, in
    blocks of bounded members and shingles, where all that may be alike is
    verified.  The first text of a cloud of several blocks is put into every
    block, so a group of copies joins at once; clouds that are not one
    component by then have every two of their blocks meet in a cell.
    """
    cells = _cells(met, "b", _all_blocks(), [[]])
    clouds = components(stars.unionByName(cells.mapInArrow(_may_be_alike(similarity), "u long, v long")))
    rows = nodes.join(clouds.withColumnRenamed("root", "cloud"), "node")
    rows = common.materialize(rows.select("node", "size", "cloud", F.col("_first._k").alias("_k"), F.col("_first._t").alias("_t"), *_SKETCH_COLUMNS), "clouds")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / cap), F.ceil(F.sum("size") / most_shingles))
    large = common.materialize(rows.groupBy("cloud").agg(parts.alias("parts")).filter("parts > 1"), "large-clouds")
    large = F.broadcast(large) if large.count() <= broadcast_rows else large
    rows = rows.join(large, "cloud", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    sets = sets_of(rows.withColumn("blk", F.pmod(F.xxhash64("node", "cloud"), F.col("parts"))))
    # the first text counts as of every block
    own = F.when(F.col("node") == F.col("cloud"), _all_blocks()).otherwise(F.array("blk"))
    first = sets.withColumn("root", F.col("node")).withColumn("blk", F.explode(own))
    links = _cells(first, "cloud", F.array("blk"), ["root", ["set"]]).mapInArrow(_alike(similarity), "u long, v long")
    links = common.materialize(links, "links")
    if not links.limit(1).count():
        roots = None
    else:
        roots = components(links)
    rest = sets.filter("parts > 1")
    rest = rest.withColumn("root", F.col("node")) if roots is None else rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("cloud").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("cloud")
    mixed = common.materialize(mixed, "open-clouds")
    many = mixed.count()
    if many:
        rest = rest.join(F.broadcast(mixed) if many <= broadcast_rows else mixed, "cloud", "left_semi")
        more = _cells(rest, "cloud", F.array_except(_all_blocks(), F.array("blk")), ["root", ["set"]]).mapInArrow(_alike(similarity), "u long, v long")
        links = common.materialize(links.unionByName(more), "all-links")
        roots = components(links) if links.limit(1).count() else None
    common.forget(rows, sets)
    return roots


def duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    bucket_cap: int = 4096, broadcast_rows: int = 200_000, most_shingles: int = 2_000_000, max_bits: int = 3,
) -> tuple[DataFrame, bool]:
    """Rows that repeat an earlier text: (_k, _t) of all rows but one of each group, and whether a row is repeated.

    Groups are the components of pairs of ``similarity`` or more (Jaccard, sets
    of ``shingle``-word shingles).  Equal texts collapse first.  The texts left
    get the operator's 64-bit fingerprints, which are filed and compared as
    above; texts of one class at ``max_bits`` are verified exactly.  Such a
    fingerprint cannot tell all pairs (at 0.8 they differ in about 10 bits), so
    for the rest each text has another of 2 bits of each of 128 min-hashes;
    texts are filed under 25 bands of five min-hashes, of which two texts at
    0.8 share none with a chance below 1 in 10,000, and meet in a bucket.
    There they are compared by fingerprint, and what may be alike is verified
    exactly on the whole texts (``_linked``).  A bucket above the cap is cut
    into blocks, and every two blocks meet in a cell of their own; so are
    clouds of texts above ``bucket_cap`` texts or ``most_shingles`` shingles.
    Of each group the row with the smallest id (nulls last, then by text hash)
    stays.
    """
    key = common.row_key(id_col, text_col)
    rows = docs.select(*key, F.col(id_col).cast("long").alias("_d"), _sketch(shingle)(F.col(text_col)).alias("_s")).select("_k", "_t", "_d", "_s.*")
    rows = common.materialize(rows, "sketches")
    least = F.min(F.struct(F.col("_d").isNull().alias("_n"), "_d", "_t", "_k"))
    nodes = rows.groupBy("hash").agg(*[F.first(f).alias(f) for f in ("fp", "size", "bands", *_SKETCH_COLUMNS)], least.alias("_first"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # narrow numbers, fixed once written
    nodes = common.materialize(nodes, "distinct-texts")
    filed = nodes.select("node", "size", "bands", *_SKETCH_COLUMNS).mapInArrow(_file_texts, FILED_TEXTS)
    shared = common.materialize(filed.groupBy("b").count().filter("count > 1").select("b", F.ceil(F.col("count") / bucket_cap).alias("parts")), "buckets")
    met = filed.join(shared, "b").withColumn("blk", F.pmod(F.xxhash64("node", "b"), F.col("parts")))
    met = common.materialize(met, "met-texts")

    def sets_of(some: DataFrame) -> DataFrame:
        named = common.materialize(some, "near-texts")
        named = F.broadcast(named) if named.count() <= broadcast_rows else named
        texts = docs.select(*key, F.col(text_col).alias("_text")).join(named, ["_k", "_t"]).drop("_k", "_t")
        return common.materialize(texts.withColumn("set", _shingle_set(shingle)(F.col("_text"))).drop("_text").dropDuplicates(["node"]), "near-sets")

    stars = _fingerprint_stars(nodes, max_bits, bucket_cap)
    roots = _linked(met, stars, nodes, sets_of, similarity, bucket_cap, most_shingles, broadcast_rows)
    common.forget(met, stars)
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root"))
    joined = nodes.join(roots, "node", "left").select("hash", F.coalesce("root", "node").alias("root"), "_first")
    best = joined.groupBy("root").agg(F.min("_first").alias("_best"))
    keep = joined.join(best, "root").select("hash", F.col("_best._k").alias("_bk"), F.col("_best._t").alias("_bt"))
    marked = rows.select("_k", "_t", "hash").join(keep, "hash")
    drops = common.materialize(marked.filter((F.col("_k") != F.col("_bk")) | (F.col("_t") != F.col("_bt"))).select("_k", "_t").distinct(), "drops")
    repeated = rows.groupBy("_k", "_t").count().filter("count > 1").limit(1).count() > 0
    common.forget(rows, nodes)
    return drops, repeated


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, **how) -> DataFrame:
    """One row of each group of near copies, with all its columns."""
    drops, repeated = duplicates(docs, id_col, text_col, broadcast_rows=broadcast_rows, **how)
    names = common.fresh_names(docs, "k", "t")
    drops = drops.toDF(*names)
    drops = F.broadcast(drops) if drops.count() <= broadcast_rows else drops
    out = docs.withColumns(dict(zip(names, common.row_key(id_col, text_col), strict=True))).join(drops, names, "left_anti")
    if repeated:
        out = out.dropDuplicates(names)
    return out.select(*docs.columns)
