"""Operator 9: token-id files, compressed by an adaptive context-mixing range coder.

Documents are range-partitioned by id, so files follow ascending doc_id; a
file holds a run of documents and its ids are cut into blocks of BLOCK ids.
Blocks are coded side by side, one numpy lane each, in step; the up to LANES
blocks of a group begin with fresh state and learn together, and every block
carries a CRC-32 of its ids.  Four predictions of an id are mixed: all mass on
the id that is expected after the two ids before it (order 2), all mass on the
one expected after the one before it (order 1), the distribution of the group's
ids (order 0, from a table of 2**16 slots in the group), and the uniform
distribution for ids that none of the others holds.  An expected id stays until
it has failed as often as it held, up to three times.  The weights depend on
how often the order-2 and order-1 predictions have been right and on whether
they agree; the weights of a context move by the shares that the predictions
had in the probability of its ids.  The sum of the weighted distributions has
cumulative values in closed form and drives a range coder with 64-bit low,
32-bit output words and carries.

Layout of a file, little-endian: MAGIC; then groups: ``<IIII`` lanes, ids per
block, bits of an id, CRC-32 of the lane table; per lane ``<II`` words and
CRC-32 of its ids; the words, in the first lane after the table of order 0
(bytes, CRC-32, zlib).  Then the document table: zlib of doc ids
(int64, null as the least value) and id counts (int64), and a footer ``<QQQI``
offset of the table, documents, ids, CRC-32 of the table.

Files are written under names no other attempt uses; a manifest written by
Spark lists those of successful attempts.

Defined results: a null or empty text has only the end id; a null doc_id comes
first; repeated ids stay together, in the order of their texts' hashes; an
empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .warc import filesystem

MAGIC = b"VLIDS003"
BLOCK = 1024
LANES = 8192
#: Ids of a block where less than a whole one is left.
SHORT = 64
NULL_ID = -(1 << 63)
_HASH_BITS = 20
_tokenizers: dict = {}


# ---------------------------------------------------------------- coder


#: Bits of the mixing weights, and of the shares of an id that move them.
_WEIGHT_BITS, _STEP = 12, 48
_ONE = 1 << _WEIGHT_BITS
#: Slots of order 0; steps that all move the weights, and every which later one does; counts at which they are halved.
_SLOTS, _EAGER, _EVERY, _FULL = 1 << 16, 64, 8, 1 << 22


def _table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of order 0 and their slots; rarer ones get none, as the uniform part codes them as well."""
    count = np.bincount(ids.ravel())
    slots = count * _SLOTS // max(1, ids.size)
    kept = np.flatnonzero(slots)
    return kept, slots[kept]


def _pack_table(ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The table as words: bytes, CRC-32, zlib of the bytes of id steps and slots, place by place."""
    plain = np.concatenate([np.diff(ids, prepend=0), slots]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    data = zlib.compress(plain)
    return np.frombuffer(struct.pack("<II", len(data), zlib.crc32(data)) + data + bytes(-len(data) % 4), "<u4")


def _unpack_table(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids, slots, and the words that the table takes."""
    raw = words.astype("<u4").tobytes()
    size, crc = struct.unpack("<II", raw[:8]) if len(raw) >= 8 else (0, 1)
    data = raw[8 : 8 + size]
    if zlib.crc32(data) != crc:
        raise ValueError("damaged table of ids")
    plain = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T
    steps, slots = np.ascontiguousarray(plain).view("<u4").ravel().astype(np.int64).reshape(2, -1)
    return np.cumsum(steps), slots, 2 + -(-size // 4)


class _Model:
    """What all lanes share: predictions with confidences, counts of the weights, order 0.

    A prediction and its confidence (0 to 3) share one number.  Masses add up
    to ``1 << bits`` more than the weights' bits; a slot's mass and that of
    every id are whole numbers.  Where lanes write to one entry in the same
    step, the last one stays.
    """

    def __init__(self, lanes: int, n: int, id_bits: int, table: tuple[np.ndarray, np.ndarray] | None = None):
        self.lanes = lanes
        self.bits = max(16, id_bits)
        self.scale = np.uint64(_WEIGHT_BITS + self.bits)
        self.kind = np.int32 if int(self.scale) <= 30 else np.int64
        self.id_bits = id_bits
        self.order2 = np.zeros(1 << _HASH_BITS, np.int32)
        self.order1 = np.zeros(1 << id_bits, np.int32)
        self.mix = np.tile(np.array([4, 4, 16, 40]), (32, 1))
        self.p1 = self.p2 = np.zeros(lanes, np.int32)
        self.below, self.count = np.zeros(1 << id_bits, self.kind), np.zeros(1 << id_bits, self.kind)
        self.slots = np.zeros(0, self.kind)
        if table is not None:
            ids, slots = table
            self.count[ids] = slots
            self.below[:] = np.cumsum(self.count) - self.count
            self.slots = np.repeat(ids, slots).astype(self.kind)
        self.many, self.steps = len(self.slots), 0
        self._weigh()

    def _weigh(self) -> None:
        """Masses of each mixing context from its counts."""
        w = self.mix[:, :3] * (_ONE - 1) // self.mix.sum(axis=1)[:, None]
        # every id has at least one part of the last weight
        rest = _ONE - w[:, 0] - w[:, 1]
        slot = w[:, 2] if self.many else np.zeros_like(rest)
        each = (rest - slot) << (self.bits - self.id_bits)
        masses = [w[:, 0] << self.bits, w[:, 1] << self.bits, (slot << self.bits) // max(1, self.many), each, (1 << int(self.scale)) - (each << self.id_bits)]
        self.masses = [m.astype(self.kind) for m in masses]

    def predict(self):
        """Weigh the predictions: masses of the order-2 and order-1 ids, of a slot of order 0, and of every id."""
        self.h2 = (self.p2 * np.int32(-1640531527) + self.p1 * np.int32(40503) >> (31 - _HASH_BITS)) & ((1 << _HASH_BITS) - 1)
        self.v2, self.v1 = self.order2.take(self.h2), self.order1.take(self.p1)
        self.c2, self.c1 = self.v2 >> 2, self.v1 >> 2
        self.same = self.c2 == self.c1
        self.state = ((self.v2 & 3) << 2 | (self.v1 & 3)) + (self.same.view(np.int8) << 4)
        self.m2, self.m1, self.slot, self.each, self.uniform = [m.take(self.state) for m in self.masses]

    def place(self, x: np.ndarray, below: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Low end and width of each lane's id; ``below`` and ``count`` are its slots of order 0.

        The uniform part lies above the others and codes the ids that none of them holds.
        """
        self.part2, self.part1, self.part0 = (x == self.c2) * self.m2, (x == self.c1) * self.m1, count * self.slot
        width = self.part0 + self.part2 + self.part1
        low = self.slot * below + (self.c2 < x) * self.m2 + (self.c1 < x) * self.m1
        new = np.flatnonzero(width == 0)
        if len(new):
            low[new], width[new] = self.uniform[new] + self.each[new] * x[new], self.each[new]
        return low, width

    def find(self, v: np.ndarray) -> np.ndarray:
        """The id whose interval holds ``v``."""
        a, b = np.minimum(self.c2, self.c1), np.maximum(self.c2, self.c1)
        both = self.m2 + self.m1
        ma = np.where(self.same, both, np.where(self.c2 < self.c1, self.m2, self.m1))
        mb = both - ma
        # how far past the low end of each predicted id, its slots and its mass
        past_a = v - self.slot * self.below.take(a)
        past_b = v - self.slot * self.below.take(b) - ma
        end_a, end_b = self.slot * self.count.take(a) + ma, self.slot * self.count.take(b) + mb
        x = np.where(past_a >= end_a, b, a)
        other = np.flatnonzero((past_a < 0) | (past_a >= end_a) & ((past_b < 0) | (past_b >= end_b)))
        if len(other):
            u, slot = v[other], self.slot[other]
            u = u - (past_a[other] >= 0) * ma[other] - (past_b[other] >= end_b[other]) * mb[other] * ~self.same[other]
            found = self.slots.take(u // np.maximum(slot, 1), mode="clip") if self.many else u
            x[other] = found
            new = other[v[other] >= self.uniform[other]]
            x[new] = (v[new] - self.uniform[new]) // self.each[new]
        return x

    def learn(self, x: np.ndarray, width: np.ndarray) -> None:
        x = x.astype(np.int32)
        x4 = x << 2
        for order, at, v, c in ((self.order2, self.h2, self.v2, self.c2), (self.order1, self.p1, self.v1, self.c1)):
            order[at] = np.where(x == c, np.minimum(v + 1, v | 3), np.where(v & 3, v - 1, x4))
        if self.steps < _EAGER or self.steps % _EVERY == 0:
            w = width.astype(np.int64)
            share = [part.astype(np.int64) * _STEP // w for part in (self.part2, self.part1, self.part0)]
            share.append(_STEP - share[0] - share[1] - share[2])
            for k in range(4):
                self.mix[:, k] += np.bincount(self.state, share[k], 32).astype(np.int64)
            full = self.mix.sum(axis=1) > _FULL
            self.mix[full] = (self.mix[full] + 1) >> 1
            self._weigh()
        self.steps += 1
        self.p2, self.p1 = self.p1, x


_LOW32, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


def encode_blocks(ids: np.ndarray, id_bits: int) -> list[np.ndarray]:
    """Code each row of ``ids`` (lanes x n, int32) into 32-bit words; the first row's begin with the table of order 0."""
    lanes, n = ids.shape
    if ids.size and (ids.min() < 0 or int(ids.max()) >> id_bits):
        raise ValueError(f"an id has more than {id_bits} bits")
    table = _table(ids)
    m = _Model(lanes, n, id_bits, table)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out, used = np.zeros((lanes, n + 4), np.uint32), np.zeros(lanes, np.int64)
    columns = np.ascontiguousarray(ids.T).astype(np.int32)
    every = np.arange(lanes)

    def carry(over):
        """A sum ran over: add one to the words already written."""
        k = 1
        while len(over):
            w = used[over] - k
            out[over, w] += np.uint32(1)
            over, k = over[out[over, w] == 0], k + 1

    for x in columns:
        m.predict()
        a, width = m.place(x, m.below.take(x), m.count.take(x))
        r = rng >> m.scale
        step = r * a.astype(np.uint64)
        low += step
        over = np.flatnonzero(low < step)
        if len(over):
            carry(over)
        rng = r * width.astype(np.uint64)
        k = np.flatnonzero(rng <= _LOW32)
        if len(k):
            lk = low[k]
            out[k, used[k]] = lk >> _32
            used[k] += 1
            low[k] = lk << _32
            rng[k] <<= _32
        m.learn(x, width)
    for _ in range(2):
        out[every, used] = low >> _32
        used += 1
        low <<= _32
    words = [out[k, : used[k]] for k in range(lanes)]
    return [np.concatenate([_pack_table(*table), words[0]]), *words[1:]] if lanes else []


def decode_blocks(words: list[np.ndarray], n: int, id_bits: int) -> np.ndarray:
    """The ids that ``encode_blocks`` coded."""
    lanes = len(words)
    size = np.array([len(w) for w in words])
    flat = np.concatenate([*[np.concatenate([w, np.zeros(2, np.uint32)]) for w in words]]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    ids, slots, skip = _unpack_table(words[0])
    at[0] += skip
    m = _Model(lanes, n, id_bits, (ids, slots))
    rng = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    gap = flat[at] << _32 | flat[np.minimum(at + 1, len(flat) - 1)]
    at = at + 2
    most, top = np.uint64((1 << int(m.scale)) - 1), (1 << id_bits) - 1
    ids = np.zeros((n, lanes), np.int32)
    for i in range(n):
        m.predict()
        r = rng >> m.scale
        x = m.find(np.minimum(gap // r, most).astype(m.kind))
        np.minimum(x, top, out=x)  # a damaged block may run on
        a, width = m.place(x, m.below.take(x), m.count.take(x))
        gap -= r * a.astype(np.uint64)
        rng = r * width.astype(np.uint64)
        k = np.flatnonzero(rng <= _LOW32)
        if len(k):
            ak = at[k]
            gap[k] = gap[k] << _32 | flat.take(ak, mode="clip")
            at[k] = ak + 1
            rng[k] <<= _32
        ids[i] = x
        m.learn(x, width)
    return np.ascontiguousarray(ids.T)


# ---------------------------------------------------------------- files


class Writer:
    """Writes one id file; ids and documents arrive in order."""

    def __init__(self, out, id_bits: int = 16):
        self.out, self.bits = out, id_bits
        self.size = out.write(MAGIC) or len(MAGIC)
        self.held: list[np.ndarray] = []
        self.pending = self.total = 0
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.pending += len(ids)
        self.total += len(ids)
        if self.pending >= BLOCK * LANES:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        at = 0
        while len(ids) - at >= BLOCK * LANES or last and len(ids) - at >= BLOCK:
            lanes = min(LANES, (len(ids) - at) // BLOCK)
            self._group(ids[at : at + lanes * BLOCK].reshape(lanes, BLOCK))
            at += lanes * BLOCK
        if last and len(ids) - at >= SHORT:
            lanes = (len(ids) - at) // SHORT
            self._group(ids[at : at + lanes * SHORT].reshape(lanes, SHORT))
            at += lanes * SHORT
        if last and at < len(ids):
            self._group(ids[at:].reshape(1, -1))
            at = len(ids)
        self.held, self.pending = [ids[at:]], len(ids) - at

    def _group(self, ids: np.ndarray) -> None:
        words = encode_blocks(ids.astype(np.int32), self.bits)
        lanes = b"".join(struct.pack("<II", len(w), zlib.crc32(row.astype("<u4").tobytes())) for w, row in zip(words, ids, strict=True))
        head = struct.pack("<IIII", len(words), ids.shape[1], self.bits, zlib.crc32(lanes))
        body = np.concatenate(words).astype("<u4").tobytes()
        self._put(head + lanes + body)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._flush(True)
        table = zlib.compress(np.array(self.docs, "<i8").reshape(-1, 2).tobytes())
        at = self.size
        self._put(table + struct.pack("<QQQI", at, len(self.docs), self.total, zlib.crc32(table)))
        self.out.close()


def read_file(f) -> Iterator[tuple[int, np.ndarray]]:
    """(doc id, ids) of an id file, in order; raises where a checksum fails."""
    size = f.size()
    at, n_docs, total, crc = struct.unpack("<QQQI", f.read_at(28, size - 28))
    table = f.read_at(size - 28 - at, at)
    if zlib.crc32(table) != crc or f.read_at(8, 0) != MAGIC:
        raise ValueError("damaged id file")
    docs = np.frombuffer(zlib.decompress(table), "<i8").reshape(n_docs, 2)
    pos, held, held_n, k = len(MAGIC), [], 0, 0
    while pos < at:
        lanes, n, bits, crc = struct.unpack("<IIII", f.read_at(16, pos))
        head = f.read_at(8 * lanes, pos + 16)
        if zlib.crc32(head) != crc:
            raise ValueError("damaged lane table")
        info = np.frombuffer(head, "<u4").reshape(lanes, 2)
        many = int(info[:, 0].sum())
        pos += 16 + 8 * lanes
        words = np.split(np.frombuffer(f.read_at(4 * many, pos), "<u4"), np.cumsum(info[:-1, 0]))
        pos += 4 * many
        ids = decode_blocks(words, n, bits)
        for row, c in zip(ids, info[:, 1].tolist(), strict=True):
            if zlib.crc32(row.astype("<u4").tobytes()) != c:
                raise ValueError("damaged block")
        held.append(ids.ravel().astype("<u4"))
        held_n += lanes * n
        if k < n_docs and held_n >= docs[k, 1]:
            flat, a = np.concatenate(held), 0
            while k < n_docs and a + docs[k, 1] <= len(flat):
                yield int(docs[k, 0]), flat[a : a + int(docs[k, 1])]
                a += int(docs[k, 1])
                k += 1
            held, held_n = [flat[a:]], len(flat) - a
    while k < n_docs:
        if docs[k, 1]:
            raise ValueError("id file ends early")
        yield int(docs[k, 0]), np.zeros(0, "<u4")
        k += 1


# ---------------------------------------------------------------- tokenizer


#: White space beside a space, where parts of a text are not encoded apart; bytes of texts that are split at once.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_RUN = 20 << 20
#: Words of a piece that the library encodes at once.
_PIECE = 200


class Encoder:
    """The library's encoding of whole texts; each distinct word of a run of texts is encoded once.

    A byte-level tokenizer that splits by its pattern encodes the parts of a
    text around a lone space apart, so words are encoded many at a time and cut
    where a token begins with a space; any other configuration, and texts with
    special strings or runs of white space, go to the library whole.  Words met
    before, up to about ``memo``, are kept.
    """

    def __init__(self, file: str, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.apart = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.apart = self.apart and not any(any(c.isspace() for c in s) for s in self.special)
        vocab = self.lib.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.limit, self.words, self.flat, self.size = memo, pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word behind a space, one after another, and their numbers."""
        odd = pc.match_substring_regex(words, f"^$|{_WHITE}$").to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~odd))
        cuts = np.append(np.arange(0, len(plain), _PIECE), len(plain)).astype(np.int32)
        pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), plain), " ").to_pylist()
        got = self._encode([" " + p for p in pieces])
        ids = np.concatenate([np.zeros(0, "<u4"), *got])
        starts = np.flatnonzero(self.spaced[ids])
        begins = np.cumsum([0, *map(len, got)])[:-1]
        if len(starts) == len(plain) and (starts[::_PIECE] == begins).all() and not odd.any():
            return ids, np.diff(np.append(starts, len(ids)))
        if len(starts) == len(plain) and (starts[::_PIECE] == begins).all():
            apart = iter(np.split(ids, starts[1:])) if len(plain) else iter(())
            loose = iter(self._encode([" " + w for w in words.filter(pa.array(odd)).to_pylist()]))
            each = [next(loose if o else apart) for o in odd.tolist()]
        else:
            each = self._encode([" " + w for w in words.to_pylist()])
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(e) for e in each], np.int64)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each of these distinct words (behind a space) has its own, and how many."""
        at = pc.index_in(words, value_set=self.words)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(missing))
        flat, size = self._spaced_words(new)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[missing] = len(self.words) + np.arange(len(new))
        flat, size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        start = (np.cumsum(size) - size)[place]
        if len(size) <= self.limit:
            self.words, self.flat, self.size = pa.concat_arrays([self.words, new]), flat, size
        else:
            self.words, self.size = words, size[place]
            self.flat = flat[_spread(start, self.size)]
        return flat, start, size[place]

    def _split(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = np.full(len(texts), not self.apart)
        if self.apart:
            whole |= pc.match_substring_regex(texts, f" {_WHITE}|{_WHITE} ").to_numpy(zero_copy_only=False)
            for s in self.special:
                whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        words, first = parts.flatten(), parts.offsets.to_numpy()
        first = first - first[0]
        named = words.dictionary_encode()
        place = named.indices.to_numpy()
        flat, start, size = self._distinct(named.dictionary)
        start, size = start.astype(np.int32)[place], size.astype(np.int32)[place]
        # no space comes before the first word of a text
        begin = words.take(pa.array(first[:-1])).dictionary_encode()
        own = self._encode(begin.dictionary.to_pylist())
        many = np.array([len(e) for e in own], np.int64)
        place = begin.indices.to_numpy()
        start[first[:-1]], size[first[:-1]] = (len(flat) + np.cumsum(many) - many)[place], many[place]
        ids = np.concatenate([flat, *own])[_spread(start, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[first].tolist()
        for k, w in enumerate(whole.tolist()):
            yield self._encode([texts[k].as_py()])[0] if w else ids[ends[k] : ends[k + 1]]

    def texts(self, texts) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow array or a sequence; null is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()), "").cast(pa.string())
        size = pc.binary_length(column).to_numpy().astype(np.int64)
        run = (np.cumsum(size) - size) // _RUN
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(column)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield from self._split(column.slice(a, b - a))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs, one after another; a run of texts has fewer than 2**31."""
    ends = np.cumsum(size)
    out = np.repeat((start - (ends - size)).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


def encoder(file: str) -> Encoder:
    if file not in _tokenizers:
        _tokenizers[file] = Encoder(file)
    return _tokenizers[file]


def vocabulary(file: str) -> int:
    """One more than the largest id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(file).get_vocab().values(), default=0) + 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- operator


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches put together up to ``_RUN`` bytes, as each distinct word of a run is encoded once."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > _RUN:
            yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield tuple(pa.concat_arrays([h.column(k) for h in held]) for k in (0, 1))


def _write(folder: str, file: str, end_id: int, id_bits: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = filesystem(folder)
        part, number, w, name = TaskContext.get().partitionId(), 0, None, ""
        end = np.array([end_id], "<u4")

        def done():
            w.close()
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([f"{path}/{name}"]), pa.array([len(w.docs)], pa.int64()), pa.array([w.total], pa.int64())], names=["part", "number", "path", "docs", "ids"])

        for docs, texts in _runs(batches):
            for d, ids in zip(docs.to_pylist(), encoder(file).texts(texts), strict=True):
                if w is None:
                    name = f"{uuid.uuid4().hex}.ids"
                    w = Writer(files.open_output_stream(f"{path}/{name}", buffer_size=1 << 20), id_bits)
                w.add(NULL_ID if d is None else d, np.concatenate([ids, end]))
                if w.total >= file_ids:
                    yield done()
                    w, number = None, number + 1
        if w is not None:
            yield done()

    return run


MANIFEST = "part int, number int, path string, docs long, ids long"


def write_ids(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, end_id: int = 2, id_bits: int | None = None, file_ids: int = 64_000_000) -> DataFrame:
    """Write token-id files in ascending doc_id order; returns the manifest with each file's first position.

    ``id_bits`` are those that the vocabulary and the end id need, or more.
    """
    spark = docs.sparkSession
    need = max(vocabulary(tokenizer_file or default_tokenizer()) - 1, end_id).bit_length()
    if id_bits is not None and id_bits < need:
        raise ValueError(f"ids need {need} bits, not {id_bits}")
    id_bits = id_bits or max(1, need)
    folder = folder or common.fresh_path(spark, "ids")
    files, path = filesystem(folder)
    files.create_dir(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = common.materialize(rows.mapInArrow(_write(folder, tokenizer_file or default_tokenizer(), end_id, id_bits, file_ids), MANIFEST), "ids-manifest")
    # one row per file: few, and bounded by the number of tasks and of files they roll
    listed = sorted(map(tuple, written.collect()))
    starts = np.concatenate([[0], np.cumsum([r[4] for r in listed], dtype=np.int64)])[:-1].tolist() if listed else []
    return spark.createDataFrame([(*r, s) for r, s in zip(listed, starts, strict=True)], MANIFEST + ", start long")


def _digests(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        for b in batches:
            for path, start in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows: list[list] = [[], [], [], [], []]

                def batch():
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                    return pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

                held = 0
                with files.open_input_file(path) as f:
                    for d, ids in read_file(f):
                        for c, v in zip(rows, (None if d == NULL_ID else d, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None), strict=True):
                            c.append(v)
                        start += len(ids)
                        held += len(ids) if with_ids else 1
                        if held >= 1_000_000:
                            yield batch()
                            rows, held = [[], [], [], [], []], 0
                if rows[0]:
                    yield batch()

    return run


def read_ids(manifest: DataFrame, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files."""
    spark = manifest.sparkSession
    rows = manifest.select("path", "start")
    rows = rows.repartitionByRange(max(1, min(rows.count(), 20_000)), "start")
    out = rows.mapInArrow(_digests(folder or common.shared_dir(spark), with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return out if with_ids else out.drop("ids")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_ids(write_ids(docs), with_ids=False)
