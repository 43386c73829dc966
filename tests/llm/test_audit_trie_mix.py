"""Filter audit, conversation trie and source mix against plain versions, and their edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import permutations

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.llm import common, filter_audit, oracle, prefix_trie, source_mix

WORDS = re.compile("[^\x20\x09-\x0d]+")


def twin(name, **tables):
    """The rows that a query's SQL gives over pandas tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df)
    return con.sql(oracle.SQL[name])


# ---------------------------------------------------------------- 11


DOCS = "doc_id long, text string, source string, part string, mask string"
LABELS = "doc_id long, quality int, toxic int, good string"
LONG = " ".join(f"w{k}" for k in range(250))
TEXTS = [None, "", "a", LONG, LONG, LONG + " #", " ".join(["w"] * 250), LONG.upper(), "A" * 3 + "b" * 97, "É#", "x\x1cy " * 300, "\t\n" * 20, LONG + " |", "😀 " * 400]


def audit_rows():
    docs = [(k, t, ["s", None, "", "s"][k % 4], "x", "y") for k, t in enumerate(TEXTS * 3)]
    docs += [(None, LONG, "s", "x", "y"), (7, TEXTS[7], "r", "x", "y"), (7, TEXTS[7], "r", "x", "y"), (-3, "only #", "t", "x", "y")]
    labels = [(k, [1, 0, None][k % 3], [0, 1, None, 1][k % 4], "z") for k in range(30)] + [(7, 0, 0, "z"), (7, 1, 1, "z"), (None, 1, 1, "z"), (9999, 1, 1, "z")]
    return docs, labels


def plain_audit(docs, labels):
    good, toxic = ({d for d, q, t, _ in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, s, *_ in docs:
        t = t or ""
        w = WORDS.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        fails.append((s or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = []
    for part in {s for s, *_ in fails}:
        mine, rows, gone = [x for x in fails if x[0] == part], [], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                out_, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                gone[f] += len(out_)
                rows.append((order, step, f, len(left), len(out_), sum(f in x[1] for x in mine) - len(out_), sum(x[1] == {f} for x in mine), sum(x[2] for x in out_), sum(x[3] for x in out_)))
        out += [(part, o, s, *x, gone[f]) for o, s, f, *x in rows]
    return out


def test_filter_audit(spark):
    docs, labels = audit_rows()
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.columns == [c.split()[0] for c in filter_audit.REPORT.split(", ")]
    assert brute.same_rows([tuple(r) for r in got.collect()], plain_audit(docs, labels))


def test_filter_audit_many_parts_and_merge(spark, monkeypatch):
    """More parts than a task holds at once, and copies beyond what is broadcast."""
    docs = [(k, ["a", LONG, "b #"][k % 3], f"p{k % 7}", "", "") for k in range(40)]
    real = filter_audit._count
    monkeypatch.setattr(filter_audit, "_count", lambda: real(2))
    small = filter_audit.failure_masks
    monkeypatch.setattr(filter_audit, "failure_masks", lambda *a: small(*a, broadcast_rows=0))
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    assert brute.same_rows([tuple(r) for r in got.collect()], plain_audit(docs, []))


def test_filter_audit_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and not table[0].any() and table[31].tolist() == [1] * 120
    assert table[0b00100].tolist() == [o.index("C") + 1 for o in filter_audit.ORDERS]


# ---------------------------------------------------------------- 12


TURNS = "conv_id long, turn long, role string, text string, key string, chars string"


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if built[c] == p))).encode()).hexdigest()
    return [(len(p), min(m), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()]


def trie_rows(n, seed, words=2, most=7):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(3 * n, n, replace=False).tolist():
        for t in range(rng.integers(0, most)):
            rows.append((c, t, ["u", "a", None][t % 3], [None, "x", "yy", "zé😀"][rng.integers(0, words + 1)], "k", "c"))
    return rows


def trie(df, **how):
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = prefix_trie.rebuild(prefix_trie.turn_runs(df), F.col("conv_id") - F.col("conv_id") % 100, head, 5)
    return [tuple(r) for r in prefix_trie.prefix_trie(convs, **how).collect()]


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_prefix_trie(spark, parts):
    """Few different turns, so nodes span many partitions; conversations that end inside others; none left of their own turns."""
    rows = trie_rows(300, parts)
    rows += [(5000 + k, t, "u", "same", "", "") for k in range(80) for t in range(8)]  # a hot conversation
    rows += [(6000, t, "u", "long" * (t % 3), "", "") for t in range(400)]  # a long one, over several partitions
    rows += [(7000, t, "u", x, "", "") for t in (None, None, 1, 1) for x in ("b", "a", "b")] + [(None, 1, "u", "lost", "", "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = trie(spark.createDataFrame(rows, TURNS).repartition(7), broadcast_rows=0 if parts == 8 else 1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert brute.same_rows(got, plain_trie(rows))


def test_prefix_trie_pieces_of_ids(spark, monkeypatch):
    """Ids that end at one node are hashed over pieces and partitions."""
    real = prefix_trie._sweep
    monkeypatch.setattr(prefix_trie, "_sweep", lambda b: real(b, packed=7))
    rows = [(k, 0, "u", "x", "", "") for k in range(0, 5000, 100)] + [(k, 0, "u", "x", "", "") for k in range(1, 90)]
    assert brute.same_rows(trie(spark.createDataFrame(rows, TURNS)), plain_trie(rows))


def test_prefix_trie_small(spark):
    assert trie(spark.createDataFrame([], TURNS)) == []
    one = [(0, None, None, None, "", "")]
    assert brute.same_rows(trie(spark.createDataFrame(one, TURNS)), plain_trie(one))
    bare = [(c, 0, "u", "x", "", "") for c in range(1, 40)]  # base absent: some lose their only turn
    assert brute.same_rows(trie(spark.createDataFrame(bare, TURNS)), plain_trie(bare))


def test_shared_turns():
    a, b = bytes(range(96)), bytes(range(50)) + b"x" * 60
    assert prefix_trie.shared_turns(a, b) == 3 and prefix_trie.shared_turns(a, a[:48]) == 3 and prefix_trie.shared_turns(a, b"") == 0


# ---------------------------------------------------------------- 13


MIX = "doc_id long, text string, source string, size long, h long, target string"


def mix_rows(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 40))), f"s{rng.integers(0, 9) ** 2 // 9}", 0, 0, "") for k in range(n)]
    rows += [(90000 + k, "w\tw\x0bw", None, 0, 0, "") for k in range(300)] + [(-5, "same words", "hot", 0, 0, "")] * 500 + [(None, "no id", "hot", 0, 0, "")] * 400
    return rows + [(80000, None, "s1", 0, 0, ""), (80001, "", "void", 0, 0, ""), (80002, " \n", "é", 0, 0, ""), (80003, "w " * 20000, "s1", 0, 0, "")]


def plain_targets(sizes, share=1.5, weights=(3, 1, 2), most=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        above = {s for s in free if level * w[s] > most * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in free}
        out |= {s: most * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        free -= above
    return out


def test_source_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, MIX)
    got = source_mix.mix(df.repartition(6)).collect()
    again = source_mix.mix(df.repartition(3, "text")).collect()
    assert brute.same_rows([tuple(r) for r in got], [tuple(r) for r in again])
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = plain_targets(sizes)
    source = {d: s for d, _, s, *_ in rows}
    by = defaultdict(int)
    for d, t, s, *_ in rows:
        by[d, len(WORDS.findall(t or ""))] += 1
    assert brute.same_rows([(r.doc_id, r.size) for r in got], [k for k, n in by.items() for _ in range(n)])
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken == r.copies * r.size and r.copies in (0, 1, 2)
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= (0.005 * t if sizes[s] > 500 else sizes[s]), (s, taken[s], t)


def test_source_mix_is_nested(spark):
    """A smaller share's mix is a part of a larger share's, but for a document a source."""
    df = spark.createDataFrame(mix_rows(800, 9)[:-1], MIX).filter("doc_id > 5")
    few, more = ({r.doc_id: r.copies for r in source_mix.mix(df, share=x).collect()} for x in (0.6, 1.1))
    assert sum(few[d] > more[d] for d in few) <= 12 and sum(few[d] < more[d] for d in few) > 100


def test_source_mix_sql_and_merge(spark, monkeypatch):
    """The SQL twin on ties of the hash; sort and merge instead of broadcasts."""
    rows = mix_rows(500, 2)
    real = source_mix._beside
    monkeypatch.setattr(source_mix, "_beside", lambda a, b, on, how="inner": real(a, b, on, how, 0))
    df = spark.createDataFrame(rows, MIX)
    got = source_mix.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = twin("op13_source_mix", documents=df.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})).fetchall()
    cut = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert brute.same_rows(map(cut, got), map(cut, want))


def test_source_mix_empty(spark):
    assert source_mix.mix(spark.createDataFrame([], MIX)).collect() == []
    none = source_mix.mix(spark.createDataFrame([(1, None, None, 0, 0, ""), (2, " ", "a", 0, 0, "")], MIX)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_queries_read_whole_tables(spark):
    """Rows of the registered queries over the smallest given tables."""
    from voltloom.llm.registry import queries

    d = "/root/testdata/sf0.001"
    q = {k: f for k, f in queries().items() if k[:4] in ("op11", "op12", "op13")}
    assert q["op13_source_mix"](spark, d).count() == common.table(spark, d, "documents").count()
    assert q["op11_filter_audit"](spark, d).count() == 600 * common.table(spark, d, "documents").select("source").distinct().count()
    nodes = q["op12_prefix_trie"](spark, d)
    assert nodes.filter("depth = 0").first().n_convs == common.table(spark, d, "conversations").select("conv_id").distinct().count()
