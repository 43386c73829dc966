"""Operator 5: exact token counts at every prefix, by dynamic programming.

For a merge-based vocabulary the encoding of a prefix is found from the
encodings of shorter prefixes: exactly one vocabulary piece ``t`` can end the
encoding of ``s[:i]``, namely the one for which (a) ``t`` encodes to itself and
(b) the last piece of ``s[:i-len(t)]`` followed by ``t`` encodes to just these
two pieces.  So ``count[i] = count[i-len(t)] + 1``, for every ``i``, in one pass.

No piece of the vocabulary crosses from a word into the next word mark, so a
text is a chain of independent units (word marks and the characters after
them); the recurrence runs once per distinct unit, and a text's counts follow
from those of its units.

The store keeps the count at every prefix as the step from the prefix before,
one signed byte a character, compressed (``store_counts``).  Whole counts, counts
of any prefix and the longest prefix within a budget are sums over the stored
steps; no text is read or encoded again.

Defined results: a null text counts as empty; an empty text has 0 tokens;
repeated rows give repeated results; an empty table gives an empty result.
Text columns of any length are processed whole, in memory proportional to the
text.  Result columns that clash with existing ones replace them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_counters: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounter:
    """Token counts of all prefixes of a text, for one sentencepiece BPE model.

    ``prefixes`` runs the recurrence on one unit; ``steps`` runs it on many
    units of equal length at once, a column of a numpy matrix per prefix.
    """

    MULT = np.uint64(0x9E3779B97F4A7C15)
    BASE = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, model_file: str, cache_units: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("the vocabulary has pieces that cross word marks")
        self.longest = max(map(len, self.score))
        self.whole = {p for p in self.score if len(p) == 1 or self.encode(p) == [p]}
        self.ends: dict[str, int] = {}
        for p in self.whole:
            self.ends[p[-3:]] = max(self.ends.get(p[-3:], 0), len(p))
        self.pair: dict = {}
        self.units = common.BatchMemo(self.steps, cache_units)
        self._tables()

    def encode(self, s: str) -> list[str]:
        """Pieces of a short string, by merging the best-scored leftmost pair."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: str, b: str) -> bool:
        ok = self.pair.get((a, b))
        if ok is None:
            if len(self.pair) > 400_000:
                self.pair.clear()
            ok = self.pair[a, b] = self.encode(a + b) == [a, b]
        return ok

    def prefixes(self, unit: str) -> list[int]:
        """``out[i]`` is the number of tokens of ``unit[:i]``, ``unit`` with its marks."""
        score, whole, ends, pair = self.score, self.whole, self.ends, self.pair
        n = len(unit)
        count, last = [0] * (n + 1), [None] * (n + 1)
        for i in range(1, n + 1):
            for size in range(min(i, ends.get(unit[i - 3 : i], 2) if i > 2 else i), 0, -1):
                t = unit[i - size : i]
                if size > 1 and t not in whole:
                    continue
                if size < i:
                    p = last[i - size]
                    ok = pair.get((p, t))
                    if not (self._follows(p, t) if ok is None else ok):
                        continue
                last[i] = t
                count[i] = count[i - size] + (1 if t in score else len(t.encode()))
                break
            else:
                raise AssertionError(f"no last piece for a prefix of {unit!r}")
        return count

    def _tables(self) -> None:
        """Substring hashes and characters of the pieces, for ``steps``."""
        self.piece = sorted(self.whole)
        self.known = np.array([p in self.score for p in self.piece])
        self.single = {p: k for k, p in enumerate(self.piece) if len(p) == 1}
        self.regular = all(c in self.single for p in self.score for c in p)
        self.power = np.cumprod(np.array([1] + [self.BASE] * self.longest, np.uint64), dtype=np.uint64)
        h = np.zeros((len(self.piece), 1), np.uint64)
        for k, p in enumerate(self.piece):
            for v in self._chars(np.array([[ord(c)] for c in p], np.uint32)):
                h[k] = h[k] * self.BASE + v
        h = h[:, 0]
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order
        self.letters = np.zeros((len(self.piece), self.longest), np.uint32)
        for k, p in enumerate(self.piece):
            self.letters[k, : len(p)] = [ord(c) for c in p]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(h * self.MULT) >> np.uint64(42)] = True
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_ok = np.zeros(1 << 20, bool)

    def _chars(self, codes: np.ndarray) -> np.ndarray:
        v = (codes.astype(np.uint64) + np.uint64(1)) * self.MULT
        return v ^ (v >> np.uint64(29))

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_follows`` for arrays of piece numbers; a negative number is a character outside the vocabulary."""
        ok = (a < 0) | (b < 0)
        at = np.flatnonzero(~ok)
        key = a[at] * np.int64(1 << 20) + b[at]
        slot = ((key.astype(np.uint64) * self.MULT) >> np.uint64(44)).astype(np.int64)
        got, miss = self.pair_ok[slot], self.pair_key[slot] != key
        if miss.any():
            new = np.unique(key[miss])
            pairs = [(self.piece[k >> 20], self.piece[k & 0xFFFFF]) for k in new.tolist()]
            good = np.array([self.encode(x + y) == [x, y] for x, y in pairs])
            got[miss] = good[np.searchsorted(new, key[miss])]
            place = ((new.astype(np.uint64) * self.MULT) >> np.uint64(44)).astype(np.int64)
            _, first = np.unique(place, return_index=True)
            self.pair_key[place[first]], self.pair_ok[place[first]] = new[first], good[first]
        ok[at] = got
        return ok

    def steps(self, words: list[str]) -> list[bytes]:
        """Steps of the prefix counts of the units that are one mark and a word."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n).tolist()
            if n > 40 or not self.regular:  # few of a length: one by one
                for k in at:
                    out[k] = _steps(self.prefixes(MARK + words[k]))
                continue
            for a in range(0, len(at), 5_000):
                some = at[a : a + 5_000]
                flat, width = self._matrix([words[k] for k in some], n + 1).tobytes(), n + 1
                for r, k in enumerate(some):
                    out[k] = flat[r * width : (r + 1) * width]
        return out

    def _matrix(self, words: list[str], n: int) -> np.ndarray:
        """Steps of units of ``n`` characters, a row per unit."""
        rows = len(words)
        codes = np.frombuffer(MARK.join(["", *words]).encode("utf-32-le"), np.uint32).reshape(rows, n)
        v = self._chars(codes)
        h = np.zeros((n + 1, rows), np.uint64)
        for i in range(n):
            h[i + 1] = h[i] * self.BASE + v[:, i]
        count = np.zeros((n + 1, rows), np.int32)
        last = np.full((n + 1, rows), -1, np.int64)
        for i in range(1, n + 1):
            open_ = np.arange(rows)
            for size in range(min(i, self.longest), 0, -1):
                x = h[i, open_] - h[i - size, open_] * self.power[size]
                at = open_
                if size > 1:
                    some = np.flatnonzero(self.maybe[(x * self.MULT) >> np.uint64(42)])
                    x, at = x[some], open_[some]
                if not len(at):
                    continue
                place = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
                found = self.hashes[place] == x
                for c in range(size):  # equal hashes are checked by their characters
                    found &= self.letters[self.ids[place], c] == codes[at, i - size + c]
                if size > 1:
                    at, piece = at[found], self.ids[place[found]]
                else:
                    piece = np.where(found, self.ids[place], -1)
                if size < i:
                    good = self._follow(last[i - size, at], piece)
                    at, piece = at[good], piece[good]
                last[i, at] = piece
                more = np.ones(len(at), np.int32)
                if size == 1 and (piece < 0).any():
                    c = codes[at, i - 1]
                    more = np.where(piece < 0, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), 1)
                count[i, at] = count[i - size, at] + more
                left = np.ones(rows, bool)
                left[at] = False
                open_ = open_[left[open_]]
                if not len(open_):
                    break
            if len(open_):
                raise AssertionError("no last piece for a prefix")
        return np.diff(count, axis=0).T.astype(np.int8)

    def texts(self, texts) -> Iterator[bytes]:
        """Steps of whole texts: of the leading mark, then of every character; empty for an empty text."""
        for run in common.slices(texts):
            words = [t.replace(MARK, " ").split(" ") if t else [] for t in run]
            held = self.units.of(set().union(*words))
            for ws in words:
                if "" in ws:
                    plain = lambda u: not u.startswith(MARK * 2) and u != MARK
                    yield b"".join([held[u[1:]] if plain(u) else _steps(self.prefixes(u)) for u in self._split(ws)])
                else:
                    yield b"".join([held[w] for w in ws])

    @staticmethod
    def _split(words: list[str]) -> Iterator[str]:
        """Units of a text: a run of marks with the characters up to the next mark."""
        marks = 0
        for w in words:
            marks += 1
            if w:
                yield MARK * marks + w
                marks = 0
        if marks:
            yield MARK * marks

    def all_prefixes(self, text: str | None) -> np.ndarray:
        """Token count of ``text[:i]`` for i = 0 ... len(text)."""
        return counts_of(next(self.texts([text])))


def _steps(counts: list[int]) -> bytes:
    return np.diff(np.array(counts)).astype(np.int8).tobytes()


def counts_of(steps: bytes) -> np.ndarray:
    """Token counts of all prefixes, from the empty one, out of a text's steps."""
    if not steps:
        return np.zeros(1, np.int32)
    out = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int32)
    out[0] = 0  # the leading mark stands before any text
    return out


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def _packed(steps: bytes) -> bytes:
    return zlib.compress(steps, 1)


def prefix_steps(text: Column | str, model_file: str | None = None) -> Column:
    """Column (n_tokens, steps): the count of the whole text, and the compressed steps of all its prefixes."""
    path = model_file or default_model()

    @F.pandas_udf("n_tokens long, steps binary")
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for s in batches:
            rows = [(int(np.frombuffer(x, np.int8).sum(dtype=np.int64)), _packed(x)) for x in c.texts(s)]
            yield pd.DataFrame(rows, columns=["n_tokens", "steps"])

    return table(text)


def prefix_counts(steps: Column | str) -> Column:
    """Column: array with the token count of every prefix, by characters, from the empty one."""

    @F.pandas_udf("array<int>")
    def table(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else counts_of(zlib.decompress(x)) for x in s], dtype=object)

    return table(steps)


def tokens_upto(steps: Column | str, n_chars: Column) -> Column:
    """Token count of the prefix of ``n_chars`` characters (or of the whole text, if shorter), from the stored steps."""

    @F.pandas_udf("long")
    def upto(s: pd.Series, n: pd.Series) -> pd.Series:
        parts = [np.frombuffer(zlib.decompress(x), np.int8)[: k + 1] if k > 0 else np.zeros(0, np.int8) for x, k in zip(s, n, strict=True)]
        return pd.Series([int(x.sum(dtype=np.int64)) for x in parts], dtype="int64")

    return upto(F.coalesce(F.col(steps) if isinstance(steps, str) else steps, F.lit(_packed(b""))), n_chars.cast("long"))


def chars_within(steps: Column | str, budget: Column) -> Column:
    """Characters in the longest prefix of at most ``budget`` tokens, from the stored steps.

    Counts may fall when a later character completes a longer piece, so the
    answer is the last prefix that fits, not the first that does not.
    """

    @F.pandas_udf("long")
    def within(s: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for x, m in zip(s, most, strict=True):
            fits = np.flatnonzero(counts_of(zlib.decompress(x)) <= m)
            out.append(int(fits[-1]) if len(fits) else 0)
        return pd.Series(out, dtype="int64")

    return within(F.coalesce(F.col(steps) if isinstance(steps, str) else steps, F.lit(_packed(b""))), budget.cast("long"))


def store_counts(docs: DataFrame, text_col: str = "text", model_file: str | None = None, path: str | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, n_bytes, n_chars, n_tokens and prefix_steps, stored at ``path`` (by default in the shared folder)."""
    spark = docs.sparkSession
    (found,) = common.fresh_names(docs, "steps")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn(found, prefix_steps(text, model_file))
    made = {"n_bytes": F.octet_length(text).cast("long"), "n_chars": F.length(text).cast("long"), "n_tokens": F.col(f"{found}.n_tokens"), "prefix_steps": F.col(f"{found}.steps")}
    out = out.withColumns(made).drop(text_col, found)
    path = path or common.fresh_path(spark, "prefix-counts")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def count_tokens(docs: DataFrame, text_col: str = "text", model_file: str | None = None, limit: int = 4096) -> DataFrame:
    """The columns of ``docs`` but the text, n_bytes, n_tokens, over_limit, and chars_within: the characters that fit the limit.

    All answers come from the stored counts.  Where the whole text fits, the
    longest prefix that fits is the text.
    """
    store = store_counts(docs, text_col, model_file)
    over = F.col("n_tokens") > limit
    fits = F.when(over, chars_within(F.when(over, F.col("prefix_steps")), F.lit(limit))).otherwise(F.col("n_chars"))
    return store.withColumns({"over_limit": over, "chars_within": fits}).drop("prefix_steps", "n_chars")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within")
