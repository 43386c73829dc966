"""Operator 12: the prefix trie of rebuilt conversations, by range sort and LCP sweep.

A turn becomes a 16-byte digest of its role and text, a conversation the
digests one after another, so bytes in order are turns in order.  Turns get
their places by a range sort (``turn_runs``): a run of a conversation's turns
that ends a partition goes on in the next, so no conversation's turns meet
before they are digests.  Conversations are then range-sorted by digests and
id.  A task sweeps its part of that order with a stack of open nodes: where two
neighbours share d turns, nodes deeper than d end and hand their sums to their
parents (``_sweep``).  Nodes on the path of a partition's first or last
conversation may go on in the partitions beside it; a task sends these two open
stacks as one row, and ``_stitch`` joins the stacks of all partitions with the
same stack rule: one row a partition, which is all that meets in one task.
Nodes below a stitched node get its conv_id by a join, and the ids that end at
stitched nodes stream in order through their hash.

Memory: a task holds one range of about ``turns_a_task`` turns.  One
conversation's digests (16 bytes a turn) are one row.  The digest of a node's
ids is sequential by definition, so the ids that end at one node are hashed by
one task, as a stream of packed strings, sorted beforehand by all.

Defined results: rows without a conv_id take no part; a null role or text is
empty; equal turns of a conversation (nulls first and equal to each other) are
ordered by the MD5 of their text with its role before it; repeated rows are
turns each; a conversation of no turns belongs to the root; an empty table
gives an empty result.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
PATH = "array<struct<conv_id:bigint,n_convs:bigint,n_children:bigint,n_leaves:bigint,saved_tokens:bigint>>"
SWEPT = (
    "kind int, part int, side int, "
    + ", ".join(f"{c} long" for c in NODE)
    + f", ends_sha256 string, seq int, ids binary, first_key binary, last_key binary, first_chars array<int>, last_chars array<int>, first_path {PATH}, last_path {PATH}"
)
SWEPT_TYPES = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("side", pa.int32())]
    + [(c, pa.int64()) for c in NODE]
    + [("ends_sha256", pa.string()), ("seq", pa.int32()), ("ids", pa.binary()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("first_chars", pa.list_(pa.int32())), ("last_chars", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.struct([(f, pa.int64()) for f in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]))) for c in ("first_path", "last_path")]
)
#: Kinds of rows: a whole node; a node whose parent is open; the two open stacks; packed ids that end at an open node.
WHOLE, UNDER_OPEN, STACKS, IDS = range(4)
NOBODY = (1 << 63) - 1


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two conversations begin with alike."""
    n = min(len(a), len(b)) // WIDTH
    low, high = 0, n
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    while low < high:  # the longest prefix, by halves
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive turns of a conversation become one row: its digests and text lengths in this partition."""
    part = TaskContext.get().partitionId()
    now, digests, chars = None, [], []

    def out(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["conv_id", "part", "key", "chars"])

    for b in batches:
        rows = []
        for conv, digest, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if conv != now:
                if now is not None:
                    rows.append((now, b"".join(digests), chars))
                now, digests, chars = conv, [], []
            digests.append(digest)
            chars.append(n)
        if rows:
            yield out(rows)
    if now is not None:
        yield out([(now, b"".join(digests), chars)])


def turn_runs(turns: DataFrame) -> DataFrame:
    """(conv_id, key, chars): a row a conversation, its turns in order as digests and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    short = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), digest.alias("digest"), F.char_length(text).alias("n"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    placed = short.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "digest", "n")
    runs = common.materialize(placed.mapInArrow(_runs, "conv_id long, part int, key binary, chars array<int>"), "trie-runs")
    # a conversation has one run, or one a partition where it spans some
    runs = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "key", "chars"))).alias("runs"))
    key = F.aggregate("runs", F.lit(b""), lambda got, r: F.concat(got, r["key"]))
    return runs.select("conv_id", key.alias("key"), F.flatten(F.transform("runs", lambda r: r["chars"])).alias("chars"))


def rebuild(convs: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """Conversations that begin with the first ``head`` turns of conversation ``base`` instead of their own."""
    bases = convs.filter(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.substring("key", 1, WIDTH * longest_head).alias("base_key"), F.slice("chars", 1, longest_head).alias("base_chars"))
    rows = convs.select("*", base.alias("base"), head.cast("int").alias("h")).join(bases, "base", "left")
    own = F.col("h") * WIDTH + 1
    key = F.concat(F.coalesce(F.col("base_key").substr(F.lit(1), F.col("h") * WIDTH), F.lit(b"")), F.col("key").substr(own, F.greatest(F.octet_length("key") - own + 1, F.lit(0))))
    chars = F.concat(F.coalesce(F.slice("base_chars", F.lit(1), F.col("h")), F.array().cast("array<int>")), F.slice("chars", F.col("h") + 1, F.greatest(F.size("chars"), F.lit(1))))
    return rows.select("conv_id", key.alias("key"), chars.alias("chars"))


class Nodes:
    """The nodes of one partition, in columns, and the stack of those still open."""

    def __init__(self):
        self.depth, self.least, self.n, self.kids, self.leaves, self.saved, self.parent = (array("q") for _ in range(7))
        self.ends: dict[int, bytes] = {}
        self.stack: list[int] = []

    def push(self, n: int) -> None:
        for _ in range(n):
            self.parent.append(self.stack[-1] if self.stack else -1)
            self.stack.append(len(self.depth))
            self.depth.append(len(self.stack) - 1)
            self.least.append(NOBODY)
            for a in (self.n, self.kids, self.leaves, self.saved):
                a.append(0)

    def close(self, chars: int) -> int:
        """Take the deepest open node off and add it to its parent."""
        i = self.stack.pop()
        if not self.kids[i]:
            self.leaves[i] = 1
        self.saved[i] += (self.n[i] - 1) * chars
        if self.stack:
            p = self.stack[-1]
            self.n[p] += self.n[i]
            self.least[p] = min(self.least[p], self.least[i])
            self.kids[p] += 1
            self.leaves[p] += self.leaves[i]
            self.saved[p] += self.saved[i]
        return i

    def partial(self, i: int) -> dict:
        return {"conv_id": self.least[i], "n_convs": self.n[i], "n_children": self.kids[i], "n_leaves": self.leaves[i], "saved_tokens": self.saved[i]}


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.record_batch([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in SWEPT_TYPES], schema=SWEPT_TYPES)


def _sweep(batches: Iterator[pa.RecordBatch], packed: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition of conversations sorted by (key, conv_id)."""
    part, nodes = TaskContext.get().partitionId(), Nodes()
    stack, first, first_chars, before, chars, ids = nodes.stack, None, None, b"", [], []

    def ended():
        if ids:
            nodes.ends[stack[-1]] = ",".join(map(str, ids)).encode()
            ids.clear()

    for b in batches:
        keys, convs, lists = b.column(0), b.column(1).to_pylist(), b.column(2)
        at, flat = lists.offsets.to_pylist(), lists.values.to_numpy()
        for k, conv in enumerate(convs):
            key = keys[k].as_py()
            if first is None or key != before:
                same = 0
                if first is None:
                    first = key
                    nodes.push(1)
                else:
                    same = shared_turns(before, key)
                    ended()
                while len(stack) > same + 1:
                    if stack[-1] <= len(first) // WIDTH:  # on the first path: what lies before it may go on in it
                        stack.pop()
                    else:
                        i = nodes.close(chars[len(stack) - 2])
                        if i in nodes.ends:
                            nodes.ends[i] = hashlib.sha256(nodes.ends[i]).digest()
                nodes.push(len(key) // WIDTH - same)
                before, chars = key, flat[at[k] : at[k + 1]].tolist()
                first_chars = chars if first_chars is None else first_chars
            i = stack[-1]
            nodes.n[i] += 1
            nodes.least[i] = min(nodes.least[i], conv)
            ids.append(conv)
    if first is None:
        return
    ended()
    top = len(first) // WIDTH  # nodes 0 to top are the first path, as they were the first to open
    last = {i: d for d, i in enumerate(stack)}
    open_ = {i: (0, i) for i in range(top + 1)} | {i: (1, d) for i, d in last.items() if i > top}
    yield _rows(kind=[STACKS], part=[part], first_key=[first], last_key=[before], first_chars=[first_chars], last_chars=[chars], first_path=[[nodes.partial(i) for i in range(top + 1)]], last_path=[[nodes.partial(i) for i in stack if i > top]])
    for i, (side, d) in open_.items():
        for seq, a in enumerate(range(0, len(nodes.ends.get(i, b"")), packed)):
            yield _rows(kind=[IDS], part=[part], side=[side], depth=[d], seq=[seq], ids=[nodes.ends[i][a : a + packed]])
    parent, least = np.array(nodes.parent), np.array(nodes.least)
    closed = np.ones(len(least), bool)
    closed[list(open_)] = False
    for a in range(0, len(least), 50_000):
        some = a + np.flatnonzero(closed[a : a + 50_000])
        if not len(some):
            continue
        under = parent[some]
        loose = ~closed[under]
        sides = np.array([open_[i][0] if x else 0 for i, x in zip(under.tolist(), loose.tolist(), strict=True)], np.int32)
        yield _rows(
            kind=np.where(loose, UNDER_OPEN, WHOLE).astype(np.int32),
            part=np.full(len(some), part, np.int32),
            side=sides,
            depth=np.array(nodes.depth)[some],
            conv_id=least[some],
            parent_conv_id=np.ma.masked_array(least[under], loose),
            **{c: np.array(x)[some] for c, x in (("n_convs", nodes.n), ("n_children", nodes.kids), ("n_leaves", nodes.leaves), ("saved_tokens", nodes.saved))},
            ends_sha256=[nodes.ends[i].hex() if i in nodes.ends else EMPTY for i in some.tolist()],
        )


STITCHED = "part int, side int, node int, first boolean, " + ", ".join(f"{c} long" for c in NODE)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole nodes from the open stacks of all partitions in order; a row for each node that a partition had open."""
    nodes, refs, lengths, before = Nodes(), [], [], b""
    stack = nodes.stack

    def down(to):
        while len(stack) > to:
            d = len(stack) - 1
            nodes.close(lengths[d - 1] if d else 0)

    def add(i, x):
        nodes.n[i] += x["n_convs"]
        nodes.least[i] = min(nodes.least[i], x["conv_id"])
        nodes.kids[i] += x["n_children"]
        nodes.leaves[i] += x["n_leaves"]
        nodes.saved[i] += x["saved_tokens"]

    for b in batches:
        for r in b.to_pylist():
            first, last = r["first_key"], r["last_key"]
            same = shared_turns(before, first)
            if stack:
                down(same + 1)
            new = len(nodes.depth)
            nodes.push(len(r["first_path"]) - len(stack))
            lengths[:] = r["first_chars"]
            for d, x in enumerate(r["first_path"]):
                add(stack[d], x)
                refs.append((r["part"], 0, d, stack[d], stack[d] >= new))
            down(shared_turns(first, last) + 1)
            lengths[:] = r["last_chars"]
            for x in r["last_path"]:
                nodes.push(1)
                add(stack[-1], x)
                refs.append((r["part"], 1, len(stack) - 1, stack[-1], True))
            before = last
    down(0)
    for a in range(0, len(refs), 50_000):
        part, side, depth, node, new = zip(*refs[a : a + 50_000], strict=True)
        parent = [nodes.parent[i] for i in node]
        cols = [
            pa.array(part, pa.int32()), pa.array(side, pa.int32()), pa.array(node, pa.int32()), pa.array(new), pa.array(depth, pa.int64()),
            pa.array([nodes.least[i] for i in node]), pa.array([None if p < 0 else nodes.least[p] for p in parent], pa.int64()),
            *[pa.array([x[i] for i in node]) for x in (nodes.n, nodes.kids, nodes.leaves, nodes.saved)],
        ]
        yield pa.record_batch(cols, names=[c.split()[0] for c in STITCHED.split(", ")])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the packed ids of each node, which come in order; a piece goes on from the one before in its partition."""
    now, sha, done = None, None, []

    def out():
        return pa.record_batch([pa.array([x for x, _ in done], pa.int32()), pa.array([h for _, h in done])], names=["node", "sha"])

    for b in batches:
        for node, seq, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if node != now:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256()
            elif seq == 0:
                sha.update(b",")
            sha.update(ids.as_buffer())
        if done:
            yield out()
            done.clear()
    if now is not None:
        done.append((now, sha.hexdigest()))
        yield out()


def prefix_trie(convs: DataFrame, turns_a_task: int = 400_000, broadcast_rows: int = 200_000) -> DataFrame:
    """A row for each distinct beginning of ``convs(conv_id, key, chars)``."""
    spark = convs.sparkSession
    convs = common.materialize(convs, "trie-conversations")
    weight = convs.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // turns_a_task))
    swept = convs.select("key", "conv_id", "chars").repartitionByRange(int(parts), "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_sweep, SWEPT)
    swept = common.materialize(swept, "trie-nodes")
    stacks = swept.filter(F.col("kind") == STACKS).select("part", "first_key", "last_key", "first_chars", "last_chars", "first_path", "last_path")
    stitched = common.materialize(stacks.repartition(1).sortWithinPartitions("part").mapInArrow(_stitch, STITCHED), "trie-stitched")
    small = stitched.count() <= broadcast_rows
    beside = lambda df: F.broadcast(df) if small else df.hint("merge")
    at = ["part", "side", "depth"]
    under = swept.filter(F.col("kind") == UNDER_OPEN).drop("parent_conv_id").withColumn("above", F.col("depth") - 1)
    open_ = stitched.select("part", "side", F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    under = under.join(beside(open_), ["part", "side", "above"])
    pieces = swept.filter(F.col("kind") == IDS).select(*at, "seq", "ids").join(beside(stitched.select(*at, "node")), at)
    pieces = pieces.repartition("node").sortWithinPartitions("node", "part", "side", "seq")
    ends = pieces.select("node", "seq", "ids").mapInArrow(_ends, "node int, sha string")
    whole = stitched.filter("first").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))
    out = [*NODE, "ends_sha256"]
    return swept.filter(F.col("kind") == WHOLE).select(*out).unionByName(under.select(*out)).unionByName(whole.select(*out))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefix_trie(rebuild(turn_runs(turns), F.col("conv_id") - F.col("conv_id") % 100, head, 5))
