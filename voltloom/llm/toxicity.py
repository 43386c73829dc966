"""Operator 10: toxic passages as maximum-scoring segments, calibrated by extreme values.

Token scores are log-odds of occurring in toxic and in clean labelled texts
under an informative Dirichlet prior (Monroe et al. 2008), lowered by their
standard error, from the number of texts that hold the token; a word too rare to tell takes the
score of its first five or four letters if many different words agree on them.
Every token also pays a drift,
so clean text runs downhill, and one linear scan (Ruzzo and Tompa 1999) finds
all maximal segments.  By Karlin-Altschul statistics a segment of score S in a
text of n tokens has ``E = K n exp(-lambda S)`` equals expected in clean text;
lambda solves ``sum p exp(lambda s) = 1`` over clean tokens and K is its
maximum-likelihood value on the clean training texts.  Segments of small E are
the passages; their evidence is added up and mapped to a probability by a
logistic curve fitted on the training texts.

Fitting uses at most ``train_rows`` labelled rows (a documented bound; those of
least hash), of which near copies count once: of rows that share three of four
min-hashes the first is taken.  Labels of the held-out fold, and languages,
sources and ids, are never used for a score.

Defined results: a null or empty text has no passages and scores like any
other text without passages; without labels of both classes every score is
the smoothed share of toxic labels; a null doc_id is not held out; repeated
rows each get a row; empty tables give empty results; other columns pass
unchanged, and columns named score, predicted or passages are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import combinations
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import phrase_index
from .simhash import shingle_hashes

THRESHOLD = 0.3


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits."""
    return phrase_index.words_of((text or "").lower())


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    lam: float = 1.0
    k: float = 1e-3
    most_expected: float = 0.05
    slope: float = 0.0
    intercept: float = -3.0

    def token(self, word: bytes) -> float:
        w = word.decode()
        s = self.words.get(w)
        if s is None and len(w) > 5:
            s = self.prefixes.get(w[:5])
        if s is None and len(w) > 4:
            s = self.prefixes.get(w[:4])
        return (s or 0.0) - self.drift


class Scorer:
    """Applies a model to texts."""

    def __init__(self, model: Model):
        self.model = model
        self.memo = common.BatchMemo(lambda ws: [model.token(w) for w in ws], 150_000)

    def passages(self, words: list[bytes], scores: dict) -> list[tuple[int, int, float]]:
        """(begin, end, score) of all maximal segments, in order of begin."""
        s = np.fromiter(map(scores.__getitem__, words), float, len(words))
        up = np.flatnonzero(s > 0)
        if not len(up):
            return []
        total = np.concatenate([[0.0], np.cumsum(s)])
        stack: list[tuple[float, float, int, int]] = []  # total before, total after, begin, end
        for i in up.tolist():
            left, right, begin = total[i], total[i + 1], i
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][0] >= left:
                    j -= 1
                if j < 0 or stack[j][1] >= right:
                    stack.append((left, right, begin, i + 1))
                    break
                left, begin = stack[j][0], stack[j][2]
                del stack[j:]
        return [(b, e, float(r - x)) for x, r, b, e in stack]

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list]:
        """Summed -log E of the segments that clean text of this length would hardly hold, and those segments."""
        m = self.model
        base = log(m.k * n) if n else 0.0
        kept = [(b, e, s, m.lam * s - base) for b, e, s in segments if base - m.lam * s <= log(m.most_expected)]
        return sum(x[3] for x in kept), kept

    def texts(self, texts) -> Iterator[tuple[float, list]]:
        m = self.model
        for run in common.slices(texts):
            words = [words_of(t) for t in run]
            held = self.memo.of(set().union(*words))
            for ws in words:
                x, kept = self.evidence(len(ws), self.passages(ws, held))
                yield 1 / (1 + exp(-min(30.0, m.intercept + m.slope * log(1 + x)))), kept


# ---------------------------------------------------------------- training


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def _min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mult = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
    for b in batches:
        out = np.zeros((b.num_rows, 4), np.uint64)
        for i, t in enumerate(b.column(1).to_pylist()):
            h = shingle_hashes(words_of(t), 5)
            if len(h):
                out[i] = [(h * m ^ h >> np.uint64(29)).min() for m in mult]
        yield pa.record_batch([b.column(0), *[pa.array(out[:, k].view(np.int64).copy()) for k in range(4)]], names=["doc_id", "a", "b", "c", "d"])


def _count(keep: set):
    """Texts that hold a word (kind 0) or a long word's first 4 or 5 letters, by label; ``many``: different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            for d, t, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if d not in keep:
                    continue
                words = {w.decode() for w in words_of(t)}
                keys = {(0, w) for w in words} | {(k, w[:k]) for w in words if len(w) > 5 for k in (4, 5)}
                for key in keys:
                    c = seen.get(key)
                    if c is None:
                        c = seen[key] = [0, 0]
                    c[1 - y] += 1
        table = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        yield pa.record_batch(
            [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.string()), pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy())],
            names=["kind", "word", "yt", "yn"],
        )

    return run


def _log_odds(yt: Column, yn: Column, nt: float, nn: float, prior: float) -> tuple[Column, Column]:
    """Dirichlet-prior log-odds and its standard error."""
    alpha = prior * (yt + yn) / (nt + nn) + 0.01
    a, b = yt + alpha, yn + alpha
    odds = F.log(a / (nt + prior - a)) - F.log(b / (nn + prior - b))
    return odds, F.sqrt(1 / a + 1 / b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 20_000, prior: float = 1000.0, least_docs: int = 4, prefix_sizes: tuple = (4, 5)) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    y = F.col(label_col).cast("int")
    pool = labels.select(F.col(id_col).cast("long").alias("doc_id"), y.alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id")
    )
    pool = pool.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(pool), "doc_id")
    # repeated rows of an id are one training row
    train = common.materialize(train.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("doc_id", "text", "y"), "toxic-train")
    kept, seen, ys = set(), set(), {0: 0, 1: 0}
    rows = train.select("doc_id", "text").mapInArrow(_min_hashes, "doc_id long, a long, b long, c long, d long")
    known = {r[0]: r[1] for r in train.select("doc_id", "y").collect()}
    for r in sorted(map(tuple, rows.collect()), key=lambda r: (r[1], r[0])):
        marks = set(combinations(enumerate(r[1:]), 3))
        if r[0] in kept or not marks.isdisjoint(seen):
            continue
        seen |= marks
        kept.add(r[0])
        ys[known[r[0]]] += 1
    share = (ys[1] + 0.5) / (ys[0] + ys[1] + 1)
    if not (ys[0] and ys[1]):
        return Model(slope=0.0, intercept=log(share / (1 - share)))
    counts = train.mapInArrow(_count(kept), "kind int, word string, yt long, yn long")
    counts = common.materialize(counts.groupBy("kind", "word").agg(F.sum("yt").alias("yt"), F.sum("yn").alias("yn")), "toxic-counts")
    every, counts = counts, counts.filter("kind = 0")
    nt, nn = (float(x or 0) for x in counts.agg(F.sum("yt"), F.sum("yn")).first())
    odds, err = _log_odds(F.col("yt"), F.col("yn"), nt, nn, prior)
    low = odds - 1.645 * err
    q = ys[1] / (ys[0] + ys[1])

    def telling(found: DataFrame) -> dict[str, float]:
        """Of keys in enough toxic texts, those whose share of toxic texts chance does not explain (Chernoff, Bonferroni)."""
        n, r = F.col("yt") + F.col("yn"), F.col("yt") / (F.col("yt") + F.col("yn"))
        clean = F.when(F.col("yn") > 0, F.col("yn") * F.log((1 - r) / (1 - q))).otherwise(0.0)
        tested = max(1, found.count())
        some = found.filter((F.col("yt") > q * n) & (F.col("yt") * F.log(r / q) + clean > log(tested / 0.05)))
        return {x[0]: x[1] for x in some.select("word", low.alias("s")).filter("s > 0.5").collect()}

    words = telling(counts.filter(F.col("yt") >= least_docs))
    prefixes: dict[str, float] = {}
    for size in prefix_sizes:
        many = counts.filter((F.length("word") > 5) & (F.col("yt") > 0)).groupBy(F.substring("word", 1, size).alias("word")).agg(F.count(F.lit(1)).alias("many"))
        prefixes |= telling(every.filter((F.col("kind") == size) & (F.col("yt") >= least_docs)).join(many.filter("many >= 3"), "word"))
    if prefixes:  # words that clean texts do hold keep their own odds
        guard = counts.filter((F.length("word") > 4) & (F.col("yn") > 0)).filter(
            F.substring("word", 1, 5).isin(list(prefixes)) | F.substring("word", 1, 4).isin(list(prefixes))
        )
        for w, s in guard.select("word", odds).collect():
            words.setdefault(w, min(s, 0.0))
    model = Model(words=words, prefixes=prefixes)
    model.lam = _karlin(counts, model, nn)
    return _calibrate(train, model, kept, known)


def _karlin(counts: DataFrame, model: Model, nn: float) -> float:
    """lambda with sum of p(w) exp(lambda s(w)) = 1 over clean tokens; positive words get half a count at least."""
    words = counts.sparkSession.createDataFrame([(w,) for w in model.words] or [("",)], "word string")
    held = counts.join(F.broadcast(words), "word").select("word", "yn").collect()  # at most the model's words
    up = [(max(n, 0.5) / nn, model.words[w] - model.drift) for w, n in held if model.words.get(w, 0) > model.drift]
    rest = 1.0 - sum(p for p, _ in up)

    def f(x):
        return rest * exp(-model.drift * x) + sum(p * exp(min(x * s, 500.0)) for p, s in up) - 1

    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def _calibrate(train: DataFrame, model: Model, kept: set, known: dict) -> Model:
    spec = json.dumps(asdict(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = Scorer(Model(**json.loads(spec)))
        for b in batches:
            ids, ns, segs = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d in kept:
                    ws = words_of(t)
                    ids.append(d)
                    ns.append(len(ws))
                    segs.append([s for _, _, s in sc.passages(ws, sc.memo.of(set(ws)))])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(segs, pa.list_(pa.float64()))], names=["d", "n", "s"])

    rows = sorted((r[0], r[1], list(r[2])) for r in train.select("doc_id", "text").mapInArrow(run, "d long, n long, s array<double>").collect())
    rows = list({r[0]: r for r in rows}.values())
    clean = [(n, max(s, default=0.0)) for d, n, s in rows if not known[d] and n]
    model.k = (len(clean) + 1) / (sum(n * exp(-model.lam * s) for n, s in clean) + 1)
    sc = Scorer(model)
    x = np.log1p([sc.evidence(n, [(0, 0, v) for v in s])[0] for _, n, s in rows])
    y = np.array([known[d] for d, _, _ in rows], float)
    a, b, ridge = 0.0, 0.0, 0.05
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    model.intercept, model.slope = float(a), float(max(b, 0.0))
    return model


# ---------------------------------------------------------------- scoring


def score_column(text: Column | str, model: Model) -> Column:
    """Column: struct of the score and the passages (begin and end in words, score, -log E)."""
    spec = json.dumps(asdict(model))

    @F.pandas_udf("score double, passages array<struct<begin:int,end:int,score:double,evidence:double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sc = Scorer(Model(**json.loads(spec)))
        for s in batches:
            got = list(sc.texts(s))
            yield pd.DataFrame({"score": [g[0] for g in got], "passages": [[{"begin": b, "end": e, "score": v, "evidence": x} for b, e, v, x in g[1]] for g in got]})

    return score(text)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted and passages."""
    (found,) = common.fresh_names(docs, "toxicity", also=("score", "passages", "predicted"))
    out = docs.withColumn(found, score_column(F.coalesce(F.col(text_col), F.lit("")), model))
    out = out.withColumns({c: F.col(f"{found}.{c}") for c in ("score", "passages")}).drop(found)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "passages")
