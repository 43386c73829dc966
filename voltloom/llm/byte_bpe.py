"""Operator 8: byte-level BPE encoding and decoding in length-bucketed numpy matrices.

Text is cut by the vocabulary's pattern; every distinct piece not met before
becomes a row of a padded matrix of token ids, rows of like length together.
In each round a hashed lookup gives the rank of every adjacent pair, each row
merges its leftmost pair of least rank, and rows are compacted to the left;
finished rows leave the matrix.  Pieces too long for a matrix use a heap of
pairs, which gives the same merges in the same order.

Defined results: a null text counts as empty and has no ids; empty tables give
empty results; repeated rows give repeated results; texts are never cut;
result columns that clash with existing ones replace them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_encoders: dict = {}

#: The pattern of the rank files for texts below U+0250 without odd controls,
#: spelt out in character classes: same matches, faster engine.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-ɏ]")
#: Spaces that stand next to other white space; elsewhere a space starts a new piece.
LOOSE_SPACE = re.compile(r" \s|\s ")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Splitter:
    """Cuts texts into chunks that can be encoded apart, and chunks into pattern matches."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.plain = pattern == default_pattern()

    def chunks(self, text: str | None) -> list[str]:
        """Runs of whole pattern matches whose concatenation is the text.

        Between a non-space and a single space before a non-space the pattern
        always cuts, so such chunks can be looked up as one.
        """
        if not text:
            return []
        if not self.plain or LOOSE_SPACE.search(text):
            return self.matches(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def many(self, chunks: list[str]) -> list[list[str]]:
        """``matches`` of each chunk."""
        if self.plain and not NOT_LATIN.search("".join(chunks)):
            return list(map(LATIN.findall, chunks))
        return list(map(self.matches, chunks))

    def matches(self, chunk: str) -> list[str]:
        if self.plain and not NOT_LATIN.search(chunk):
            return LATIN.findall(chunk)
        return self.pattern.findall(chunk)


class MatrixBPE:
    """Encoder and decoder for one rank file."""

    MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, rank_file: str, pattern: str, longest_row: int = 256, cells: int = 400_000, memo: int = 200_000):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.splitter = Splitter(pattern)
        self.longest_row, self.cells = longest_row, cells
        self.bytes_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.memo = common.BatchMemo(self._chunk_values, memo)
        self._pair_table()
        self.decimal = list(map(str, range(max(self.ranks.values()) + 1)))
        size = max(self.ranks.values()) + 1
        self.length = np.zeros(size, np.int64)
        for t, r in self.ranks.items():
            self.length[r] = len(t)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def _pair_table(self) -> None:
        """Hash table from (left id, right id) to the rank of the joined bytes, open addressing."""
        keys, vals = [], []
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(r)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.val = np.full(1 << bits, np.iinfo(np.int64).max, np.int64)
        key, val, step = np.array(keys, np.int64), np.array(vals, np.int64), 0
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.key[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.val[slot[put]] = key[put], val[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, val, slot = key[rest], val[rest], (slot[rest] + 1) & (len(self.key) - 1)
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * self.MULT) >> self.shift).astype(np.int64)

    NONE = np.iinfo(np.int64).max

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or NONE."""
        key = left << 32 | right
        slot = self._slot(key)
        held = self.key[slot]
        out = np.where(held == key, self.val[slot], self.NONE)
        at = np.flatnonzero((held != key) & (held != -1))
        for _ in range(self.probes):
            if not len(at):
                break
            slot[at] = (slot[at] + 1) & (len(self.key) - 1)
            held = self.key[slot[at]]
            hit = held == key[at]
            out[at[hit]] = self.val[slot[at[hit]]]
            at = at[~hit & (held != -1)]
        return out

    def encode_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where each piece's ids end."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(size, kind="stable")
        lengths = np.zeros(len(pieces), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # rows, and their ids one after the other
        k = int(np.searchsorted(size[order], 1))
        while k < len(order):
            n = int(size[order[k]])
            if n > self.longest_row:
                ids = self._encode_long(pieces[order[k]])
                lengths[order[k]] = len(ids)
                found.append((order[k : k + 1], ids))
                k += 1
                continue
            width = min(self.longest_row, 4 * -(-n // 4))  # buckets of four lengths
            end = min(int(np.searchsorted(size[order], width, "right")), k + max(1, self.cells // width))
            rows = order[k:end]
            for live, ids, many in self._encode_matrix([pieces[i] for i in rows], size[rows], width):
                lengths[rows[live]] = many
                found.append((rows[live], ids))
            k = end
        ends = np.cumsum(lengths)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for rows, ids in found:
            many = lengths[rows]
            done = np.cumsum(many)
            flat[np.repeat(ends[rows] - done, many) + np.arange(len(ids))] = ids
        return flat, ends

    def _encode_matrix(self, pieces: list[bytes], size: np.ndarray, width: int) -> Iterator[tuple]:
        """Yields finished rows: their numbers, their ids one after the other, and how many each has."""
        m = self.bytes_id[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), width)]
        size, live = size.copy(), np.arange(len(pieces))
        col = np.arange(width)
        rank = np.full((len(pieces), width), self.NONE, np.int64)
        r, c = np.nonzero(col[None, :-1] < (size - 1)[:, None])
        rank[r, c] = self.pair_ranks(m[r, c], m[r, c + 1])
        while len(live):
            at = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(live)), at]
            ends = best == self.NONE
            if ends.any():
                yield live[ends], m[ends][col[None, :] < size[ends][:, None]], size[ends]
                keep = ~ends
                m, rank, size, live, at, best = m[keep], rank[keep], size[keep], live[keep], at[keep], best[keep]
                if not len(live):
                    break
            row = np.arange(len(live))
            m[row, at] = best
            # compact: the cells right of the merged pair move one to the left
            source = np.minimum(col[None, :] + (col[None, :] > at[:, None]), width - 1) + row[:, None] * width
            m, rank = m.ravel()[source], rank.ravel()[source]
            size -= 1
            rank[:, -1] = self.NONE
            rank[row, at] = self.NONE
            k = np.flatnonzero(at + 1 < size)
            rank[k, at[k]] = self.pair_ranks(m[k, at[k]], m[k, at[k] + 1])
            k = np.flatnonzero(at > 0)
            rank[k, at[k] - 1] = self.pair_ranks(m[k, at[k] - 1], m[k, at[k]])
            used = int(size.max())
            if used < width - 3:
                width, col = used + 1, np.arange(used + 1)
                m, rank = np.ascontiguousarray(m[:, :width]), np.ascontiguousarray(rank[:, :width])

    def _encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, position)."""
        ids = self.bytes_id[np.frombuffer(piece, np.uint8)].tolist()
        token = [piece[i : i + 1] for i in range(len(piece))]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if token[i] is not None else -1
            if j < 0 or self.ranks.get(token[i] + token[j]) != r:
                continue
            token[i], token[j], ids[i] = token[i] + token[j], None, r
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(token[a] + token[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x, t in zip(ids, token, strict=True) if t is not None], np.int64)

    def _chunk_values(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        """For each chunk: its ids in decimal, comma-joined, and as little-endian 32-bit integers."""
        parts = self.splitter.many(chunks)
        flat, ends = self.encode_rows([p.encode() for ps in parts for p in ps])
        last = np.concatenate([[0], ends])[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))].tolist()
        text, raw, a, out = [self.decimal[i] for i in flat.tolist()], flat.astype("<u4").tobytes(), 0, []
        for b in last:
            out.append((",".join(text[a:b]), raw[4 * a : 4 * b]))
            a = b
        return out

    def encode_texts(self, texts) -> Iterator[tuple[str, np.ndarray]]:
        """For each text: its ids in decimal, comma-joined, and as an array."""
        for run in common.slices(texts):
            chunks = [self.splitter.chunks(t) for t in run]
            held = self.memo.of(set().union(*chunks))
            for cs in chunks:
                values = [held[c] for c in cs]
                yield ",".join([v[0] for v in values]), np.frombuffer(b"".join([v[1] for v in values]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, gathered from the vocabulary at once."""
        size = self.length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)].tobytes()


def encoder(rank_file: str, pattern: str) -> MatrixBPE:
    if (rank_file, pattern) not in _encoders:
        _encoders[rank_file, pattern] = MatrixBPE(rank_file, pattern)
    return _encoders[rank_file, pattern]


def encode_column(text: Column | str, rank_file: str | None = None, pattern: str | None = None) -> Column:
    """Column: array of token ids."""
    rank_file, pattern = rank_file or default_ranks(), pattern or default_pattern()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(rank_file, pattern)
        for s in batches:
            yield pd.Series([x.astype(np.int32) for _, x in e.encode_texts(s)], dtype=object)

    return ids(text)


def decode_column(ids: Column | str, rank_file: str | None = None, pattern: str | None = None) -> Column:
    """Column: the bytes of an array of token ids; null for null."""
    rank_file, pattern = rank_file or default_ranks(), pattern or default_pattern()

    @F.pandas_udf("binary")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(rank_file, pattern)
        for s in batches:
            yield pd.Series([None if x is None else e.decode(np.asarray(x, np.int64)) for x in s], dtype=object)

    return text(ids)


def encode_digests(docs: DataFrame, text_col: str = "text", rank_file: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 (and ``ids``), from one pass over the texts."""
    rank_file, pattern = rank_file or default_ranks(), pattern or default_pattern()
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(rank_file, pattern)
        for s in batches:
            rows = [
                (len(x), hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(e.decode(x)).hexdigest(), *[x.astype(np.int32)] * with_ids)
                for t, x in e.encode_texts(s)
            ]
            yield pd.DataFrame(rows, columns=names)

    (found,) = common.fresh_names(docs, "bpe", also=tuple(names))
    out = docs.withColumn(found, digest(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumns({c: F.col(f"{found}.{c}") for c in names}).drop(found)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
