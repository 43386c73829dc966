"""Operator 3: benchmark decontamination with a positional inverted index.

``build_index`` stores the postings of every training token.  The index is
partitioned by documents: a segment holds about ``segment_words`` words of
whole documents, and in it every term has one ascending list of positions.
Positions of different documents never touch, so a phrase cannot cross.  A
segment is stored as ``BUCKETS`` buckets of terms and a part for its documents,
so a search reads only the buckets of its own terms.  Tasks append their
segments to files in the shared folder, under names no other attempt uses; a
manifest that Spark commits lists the segments of successful attempts.

A phrase is found by taking its rarest term's list (rarest in the segment)
and intersecting it with the offset-adjusted lists of its other terms, from
rare to frequent; a proximity match asks for one position of each term within
a span of ``window`` words of one document.

The test set is stored in blocks of at most ``block_words`` words (and one
window); a search task goes through all blocks for each of its segments, where
the segment lies: no posting is ever shuffled, nothing passes through the
driver, and a task holds one block and the lists of its terms in one segment.

Defined results: a null or empty text has no words and no hits; an item
without words matches nothing; repeated items with one id count once; repeated
documents each get a row; a null item_id is listed as an empty string; empty
tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .warc import filesystem

#: Bytes of words: digits, letters, everything outside ASCII; A-Z lowered, all else a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BUCKETS = 32
INDEX = "path string, offset long, words long, docs long"
_DOCUMENTS = pa.schema([("doc_id", pa.string()), ("tag", pa.int64()), ("start", pa.int64())])
_PART = struct.Struct("<QQ")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return (text or "").encode().translate(_WORD_BYTES).split()


# ---------------------------------------------------------------- index


def _segments(folder: str, segment_words: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        vocab: defaultdict = defaultdict(count().__next__)
        codes, starts, ids, tags, at = [], [], [], [], 0
        out, name, size, listed = None, "", 0, []

        def flush():
            nonlocal vocab, codes, starts, ids, tags, at, out, name, size
            if out is None or size >= file_bytes:
                if out is not None:
                    out.close()
                name, size = f"{path}/{uuid.uuid4().hex}.seg", 0
                out = files.open_output_stream(name, buffer_size=1 << 20)
            data = _segment(vocab, codes, starts, at, ids, tags)
            out.write(data)
            listed.append((name, size, at - len(ids), len(ids)))
            size += len(data)
            vocab = defaultdict(count().__next__)
            codes, starts, ids, tags, at = [], [], [], [], 0

        for b in batches:
            texts = b.column(0)
            for row, (d, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                ws = words_of(texts[row].as_py())
                codes.append(np.fromiter(map(vocab.__getitem__, ws), np.int32, len(ws)))
                starts.append(at)
                ids.append(d)
                tags.append(t)
                at += len(ws) + 1  # the free position keeps documents apart
                if at >= segment_words:
                    flush()
        if ids:
            flush()
        if out is not None:
            out.close()
            cols = list(zip(*listed, strict=True))
            yield pa.record_batch([pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["path", "offset", "words", "docs"])

    return run


def _pack(parts: list[bytes]) -> bytes:
    return b"".join([_PART.pack(len(parts), 0), *[_PART.pack(len(p), 0) for p in parts], *parts])


def _unpack(data: bytes) -> list[bytes]:
    n = _PART.unpack_from(data, 0)[0]
    at, out = _PART.size * (n + 1), []
    for k in range(n):
        size = _PART.unpack_from(data, _PART.size * (k + 1))[0]
        out.append(data[at : at + size])
        at += size
    return out


def _segment(vocab, codes, starts, end, ids, tags) -> bytes:
    """A segment: a table of (packed, raw) sizes, then its documents and each bucket of terms, compressed."""
    starts = np.array([*starts, end], np.int64)
    code = np.concatenate(codes)
    length = np.diff(starts) - 1
    position = np.repeat(starts[:-1] - (np.cumsum(length) - length), length) + np.arange(len(code))
    terms = list(vocab)
    hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in terms), np.uint64, len(terms))
    # terms by bucket, then hash; postings by term, then position
    by = np.lexsort((hashes, hashes % np.uint64(BUCKETS)))
    rank = np.empty(len(terms), np.int64)
    rank[by] = np.arange(len(terms))
    key = rank[code]
    position = position[np.argsort(key, kind="stable")]
    counts = np.bincount(key, minlength=len(terms))
    ends = np.cumsum(counts)
    delta = np.diff(position, prepend=0)
    delta[(ends - counts)[counts > 0]] = position[(ends - counts)[counts > 0]]
    edges = np.searchsorted((hashes[by] % np.uint64(BUCKETS)).astype(np.int64), np.arange(BUCKETS + 1))
    docs = pa.record_batch([pa.array([*ids, None], pa.string()), pa.array([*tags, None], pa.int64()), pa.array(starts)], schema=_DOCUMENTS)
    raw = [docs.serialize().to_pybytes()]
    for k in range(BUCKETS):
        a, b = int(edges[k]), int(edges[k + 1])
        p, q = (int(ends[a] - counts[a]), int(ends[b - 1])) if a < b else (0, 0)
        raw.append(_pack([hashes[by[a:b]].astype("<u8").tobytes(), counts[a:b].astype("<i4").tobytes(), delta[p:q].astype("<i4").tobytes(), b" ".join([terms[i] for i in by[a:b]])]))
    packed = [pa.compress(x, codec="zstd", asbytes=True) for x in raw]
    return b"".join([_PART.pack(len(x), len(y)) for x, y in zip(packed, raw, strict=True)] + packed)


class Segment:
    """A stored segment, read part by part."""

    def __init__(self, f, offset: int):
        self.f = f
        head = f.read_at(_PART.size * (BUCKETS + 1), offset)
        self.sizes = [_PART.unpack_from(head, _PART.size * k) for k in range(BUCKETS + 1)]
        self.at = offset + len(head) + np.concatenate([[0], np.cumsum([a for a, _ in self.sizes])])
        self.docs = pa.ipc.read_record_batch(pa.py_buffer(self._part(0)), _DOCUMENTS)
        self.starts = self.docs.column(2).to_numpy(zero_copy_only=False)

    def _part(self, k: int) -> bytes:
        packed, raw = self.sizes[k]
        return pa.decompress(self.f.read_at(packed, int(self.at[k])), decompressed_size=raw, codec="zstd", asbytes=True)

    def lists(self, wanted: dict[int, tuple[int, bytes]]) -> dict[int, np.ndarray]:
        """Positions of the wanted terms (by hash: number and term) that the segment has."""
        out: dict[int, np.ndarray] = {}
        want = np.array(sorted(wanted), np.uint64)
        for bucket in np.unique(want % np.uint64(BUCKETS)).tolist():
            hashes, counts, delta, terms = _unpack(self._part(bucket + 1))
            hashes = np.frombuffer(hashes, "<u8")
            at = np.flatnonzero(np.isin(hashes, want))
            if not len(at):
                continue
            counts = np.frombuffer(counts, "<i4").astype(np.int64)
            ends = np.cumsum(counts)
            delta, terms = np.frombuffer(delta, "<i4"), terms.split(b" ")
            for k in at.tolist():
                number, term = wanted[int(hashes[k])]
                if terms[k] == term:
                    out[number] = np.cumsum(delta[ends[k] - counts[k] : ends[k]], dtype=np.int64)
        return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = 1_000_000, file_bytes: int = 1 << 30) -> DataFrame:
    """Index all words of ``docs`` in the shared folder; returns the manifest of its segments."""
    spark = docs.sparkSession
    folder = common.fresh_path(spark, "phrase-index")
    files, path = filesystem(folder)
    files.create_dir(path)
    rows = docs.select(F.col(text_col), F.col(id_col).cast("string"), F.xxhash64(F.col(text_col))).toDF("text", "id", "tag")
    return common.materialize(rows.mapInArrow(_segments(folder, segment_words, file_bytes), INDEX), "segments")


# ---------------------------------------------------------------- search


def find_phrase(lists: dict[int, np.ndarray], terms: tuple[int, ...]) -> np.ndarray:
    """Start positions of a phrase, from the rarest term on."""
    if any(t not in lists for t in terms):
        return np.zeros(0, np.int64)
    order = sorted(range(len(terms)), key=lambda k: len(lists[terms[k]]))
    start = lists[terms[order[0]]] - order[0]
    for k in order[1:]:
        other = lists[terms[k]]
        want = start + k
        at = np.searchsorted(other, want)
        at[at == len(other)] = len(other) - 1
        start = start[other[at] == want]
        if not len(start):
            break
    return start


def find_near(lists: dict[int, np.ndarray], terms: tuple[int, ...], window: int, starts: np.ndarray) -> np.ndarray:
    """Least position of each occurrence of all terms within ``window`` words of one document.

    An occurrence begins at a position of some term from which every other
    term's next position lies inside the window; only such minimal starts count.
    """
    terms = tuple(dict.fromkeys(terms))
    if any(t not in lists for t in terms):
        return np.zeros(0, np.int64)
    begin = np.unique(np.concatenate([lists[t] for t in terms]))
    doc_end = starts[np.searchsorted(starts, begin, "right")]
    limit = np.minimum(begin + window, doc_end)
    for t in sorted(terms, key=lambda x: len(lists[x])):
        at = np.searchsorted(lists[t], begin)
        ok = at < len(lists[t])
        ok[ok] = lists[t][at[ok]] < limit[ok]
        begin, limit = begin[ok], limit[ok]
    return begin


def _covered(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals given by ascending begins."""
    top = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > top[:-1]])
    at = np.flatnonzero(new)
    return begin[at], top[np.concatenate([at[1:] - 1, [len(begin) - 1]])]


class _Block:
    """A block of the test set: its windows, as numbers of terms, and its terms by hash."""

    def __init__(self, rows: pa.Table):
        number: dict[bytes, int] = {}
        windows = dict.fromkeys(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))
        self.phrases = [(item, tuple(number.setdefault(w, len(number)) for w in ws.split(b" "))) for item, ws in windows]
        self.wanted = {xxhash.xxh64_intdigest(w): (k, w) for w, k in number.items()}


def _search(folder: str, blocks: str, window: int | None, digest: bool):
    """A row per document of each segment, with its hit spans merged by item, or digests of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        names = _block_files(files, blocks)
        held: dict[str, _Block] = {}

        def block(name: str) -> _Block:
            if name not in held:
                held.clear()
                with files.open_input_file(name) as f:
                    held[name] = _Block(pa.ipc.open_file(f).read_all())
            return held[name]

        for b in batches:
            for path, offset in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_input_file(path) as f:
                    seg = Segment(f, offset)
                    spans: defaultdict = defaultdict(list)  # by item
                    for name in names:
                        for item, begin, end in _hits(seg, block(name), window):
                            spans[item].append((begin, end))
                yield _documents(seg, spans, digest)

    return run


def _hits(seg: Segment, block: _Block, window: int | None) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    lists = seg.lists(block.wanted)
    for item, terms in block.phrases:
        found = find_phrase(lists, terms) if window is None else find_near(lists, terms, window, seg.starts)
        if len(found):
            yield item, found, found + (len(terms) if window is None else window)


def _documents(seg: Segment, spans: dict, digest: bool) -> pa.RecordBatch:
    starts = seg.starts
    per_doc: defaultdict = defaultdict(list)
    for item, parts in spans.items():
        begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(begin, kind="stable")
        begin, end = _covered(begin[order], end[order])
        doc = np.searchsorted(starts, begin, "right") - 1
        end = np.minimum(end, starts[doc + 1] - 1)
        for d, a, b in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist(), strict=True):
            per_doc[d].append((item, a, b))
    n = seg.docs.num_rows - 1
    found = [per_doc.get(d, ()) for d in range(n)]
    documents = [seg.docs.column(0)[:n], seg.docs.column(1)[:n], pa.array(np.diff(starts) - 1)]
    if digest:
        cols = zip(*[_digest(x) for x in found], strict=True) if found else ((), (), ())
        lists = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)]
    else:
        lists = [pa.array([[s[k] for s in x] for x in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return pa.record_batch([*documents, *lists], names=(DIGESTS if digest else MATCHES).replace(",", "").split()[::2])


MATCHES = "doc_key string, doc_tag long, n_words long, items array<string>, begins array<int>, ends array<int>"
DIGESTS = "doc_key string, doc_tag long, n_words long, n_hit long, n_items long, items_sha256 string"


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` words; a shorter text that has words is one window."""
    if not words:
        return []
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


_WINDOWS = pa.schema([("item", pa.string()), ("words", pa.binary())])


def _block_files(files, folder: str) -> list[str]:
    """Files of the blocks that the manifest lists."""
    from pyarrow import parquet

    _, path = filesystem(folder)
    return sorted(parquet.read_table(f"{path}/manifest", filesystem=files, columns=["path"]).column(0).to_pylist())


def _store_blocks(folder: str, size: int, block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        rows, held, names = [], 0, []

        def put():
            names.append(f"{path}/{uuid.uuid4().hex}.block")
            with files.open_output_stream(names[-1]) as out, pa.ipc.new_file(out, _WINDOWS) as w:
                w.write(pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], schema=_WINDOWS))

        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in windows_of(words_of(text), size):
                    rows.append((item, b" ".join(w)))
                    held += len(w)
                    if held >= block_words:
                        put()
                        rows, held = [], 0
        if rows:
            put()
        yield pa.record_batch([pa.array(names, pa.string())], names=["path"])

    return run


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10, window: int | None = None, block_words: int = 1_000_000) -> DataFrame:
    """A row per document: its key, word count, and spans (item, begin, end) in words that items hit.

    ``window=None``: exact occurrences of every ``size``-word window of an item.
    Otherwise: places where all words of such a window stand within ``window`` words.
    """
    return _run(index, items, id_col, text_col, size, window, block_words, False)


def _run(index: DataFrame, items: DataFrame, id_col: str, text_col: str, size: int, window: int | None, block_words: int, digest: bool) -> DataFrame:
    spark = index.sparkSession
    blocks = common.fresh_path(spark, "test-blocks")
    files, path = filesystem(blocks)
    files.create_dir(path)
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).toDF("item", "text")
    texts.mapInArrow(_store_blocks(blocks, size, block_words), "path string").write.parquet(f"{blocks}/manifest")
    segments = index.select("path", "offset")
    segments = segments.repartition(max(1, min(index.count(), 20_000)))
    return segments.mapInArrow(_search(common.shared_dir(spark), blocks, window, digest), DIGESTS if digest else MATCHES)


_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _digest(spans: list[tuple[str, int, int]]) -> tuple[int, int, str]:
    """(words hit, items, SHA-256 of the items) of the spans of a document."""
    if not spans:
        return 0, 0, _NO_ITEMS
    begin, end = (np.array([s[k] for s in spans]) for k in (1, 2))
    order = np.argsort(begin, kind="stable")
    begin, end = _covered(begin[order], end[order])
    names = sorted({s[0] for s in spans})
    return int((end - begin).sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 10, segment_words: int = 1_000_000, block_words: int = 1_000_000) -> DataFrame:
    """A row per document: doc_key, doc_tag, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build_index(docs, id_col, text_col, segment_words)
    found = _run(index, items, item_col, item_text, size, None, block_words, True)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    items = common.table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = contamination(docs, items)
    return out.select(F.col("doc_key").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
