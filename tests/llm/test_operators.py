"""Each operator against a plain version, and its edge cases."""

import base64
import hashlib
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltloom.llm import (
    byte_bpe,
    common,
    components,
    id_files,
    line_dedup,
    main_text,
    phrase_index,
    simhash,
    token_counts,
    topk,
    toxicity,
    warc,
)

LONG = "this line is long enough to be counted as one"
DOCS = "doc_id long, text string, text_ string, n_tokens string"  # an extra column, and one that clashes
ODD = [None, "", " ", "\n", "\n\n", "a", "Ein Wort", "é" * 50, "x" * 5000, " ".join(["word"] * 3000), f"{LONG}\nother\n{LONG}", "tab\tand\x0bfeed\x1c", "日本語 テキスト", "😀 <s> <|endoftext|> </s>"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    texts = ODD + ODD[:6] + [f"{LONG}\n{k}" for k in range(6)]
    ids = [*range(len(ODD)), *range(100, 106), *range(6)]
    ids[3] = None
    return frame(spark, texts, ids), list(zip(ids, texts))


# ---------------------------------------------------------------- 1


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="cookie-notice">We use cookies, as many words as you like to read here, and more of them still.</div>
<article><h1>Title &lt;here&gt;</h1><p>Some <b>bold</b>\n  text &eacute;.<br>Next</p><p>One.</p><form><p>Type your name into this form and send it to us please, thank you.</p></form>
<aside>Read also these many words that stand in a box beside the text of the page.</aside></article>
<section id="comments"><article class="comment"><p>I as a reader say a lot of words about this article, all of them my own.</p></article></section>
<!-- <p>hidden words</p> --><noscript>No script</noscript><footer>(c) all rights reserved by us and nobody else in the whole wide world</footer></body></html>"""


def test_main_text():
    tree = main_text.fit()
    assert main_text.main_text(PAGE, tree) == "Title <here> Some bold text é. Next One."
    for bad in (None, "", "<p", "<!-- never closed <p>x</p>", "<script>x", "</p></div>", "<nav>a b c</nav>"):
        assert main_text.main_text(bad, tree) == ""
    cut = PAGE[: PAGE.index("<p>One") + 4]
    assert main_text.main_text(cut, tree).startswith("Title <here> Some bold")
    rows, labels = main_text.labelled()
    assert [tree.predict(r) for r in rows] == labels


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "")], "page_id long, text string, html string")
    got = sorted((r.page_id or -1, r.text, r.n_chars) for r in main_text.extract_main_text(pages).collect())
    assert got == [(-1, "", 0), (1, "Title <here> Some bold text é. Next One.", 40), (2, "", 0), (2, "", 0)]
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 2


def test_warc_round_trip(spark):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(5, "http://a/ b?é=1", trap), (3, "u", trap), (9, None, None), (8, "", ""), (None, "n", "only"), (4, "u", "y" * 300_000), (7, "u", "é"), (7, "u", "é"), (2, "w", trap * 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for split in (200, 1000, 1 << 20):
        m = warc.write_archives(pages.repartition(2), file_bytes=2000)
        got = warc.read_archives(m, split_bytes=split).collect()
        assert len(got) == len(rows) and sum(r.records for r in m.collect()) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r.page_id, []).append(r)
        for i, url, html in rows:
            raw = (html or "").encode()
            first = min([k for k, _, h in rows if (h or "") == (html or "") and k is not None], default=None)
            for r in by[i]:
                assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), url)
                assert r.record_type == ("response" if first in (None, i) else "revisit")
                assert r.refers_to == (None if first in (None, i) else first)
                assert bytes(r.payload) == (raw if r.record_type == "response" else b"")
    long = spark.createDataFrame([(1, "u" * 1_100_000, "a"), (2, "é" * 400_000, "b"), (3, None, "c" * 10)], "page_id long, url string, html string")
    for split in (50_000, 16 << 20):
        got = warc.read_archives(warc.write_archives(long.coalesce(1)), split_bytes=split).collect()
        assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == sorted(tuple(r) for r in long.collect())
    small = warc.write_archives(pages, least_revisit=10)
    assert {r.record_type for r in warc.read_archives(small).collect() if r.page_id in (8, 9)} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_damage(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "text " * k) for k in range(40)], "page_id long, url string, html string")
    m = warc.write_archives(pages.coalesce(1))
    path = m.first().path
    raw = open(path, "rb").read()
    at = raw.index(b"WARC/1.1", len(raw) // 2)
    for bad in (raw[:at] + b"WARX" + raw[at + 4 :], raw[: len(raw) - 3]):
        open(path, "wb").write(bad)
        with pytest.raises(ValueError, match="break off"):
            warc.read_archives(m)
    open(path, "wb").write(raw[:at] + b"WARX" + raw[at + 4 :])
    kept = warc.read_archives(m, damaged="keep").count()
    assert 0 < kept < 40
    open(path, "wb").write(raw)
    assert warc.read_archives(m, split_bytes=100).count() == 40
    extra = pages.selectExpr("*", "'z' AS path", "7 AS digest", "'q' AS first", "1 AS size")
    assert warc.read_archives(warc.write_archives(extra)).count() == 40


# ---------------------------------------------------------------- 3


def test_contamination(spark, odd):
    docs, rows = odd
    items = [(1, "Word word WORD word word word word word word word word"), (2, LONG), (2, LONG), (3, None), (4, "Wort"), (5, "!!"), (None, "tab and"), (10, "é" * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for segment, block in ((1_000_000, 1_000_000), (50, 12)):
        got = phrase_index.contamination(docs, bench, segment_words=segment, block_words=block)
        got = [(None if r.doc_key is None else int(r.doc_key), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
        assert brute.same_rows(got, brute.contamination(rows, items))
    assert phrase_index.contamination(docs.limit(0), bench).count() == 0
    none = phrase_index.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_proximity(spark):
    docs = frame(spark, ["alpha x y beta", "alpha x x x x x x beta", "beta", "alpha"])
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = phrase_index.search(phrase_index.build_index(docs), items, window=5).collect()
    assert {int(r.doc_key): [tuple(x) for x in zip(r["items"], r.begins)] for r in got} == {0: [("1", 0)], 1: [], 2: [], 3: []}


# ---------------------------------------------------------------- 4


def test_line_dedup(spark, odd):
    docs, rows = odd
    rows = [(d, t) for d, t in rows]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs).collect()]
    want = brute.line_dedup(rows)
    assert brute.same_rows(got, want) and any(w[2] for w in want)
    merged = line_dedup.dedup_lines(docs, broadcast_rows=0)
    assert brute.same_rows([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in merged.collect()], want)
    assert set(merged.columns) == {*docs.columns, "n_lines", "n_dropped", "kept"}
    clash = line_dedup.dedup_lines(docs.selectExpr("*", "1 AS _d", "2 AS _T", "3 AS _drop", "4 AS n_lines", "5 AS kept"))
    assert brute.same_rows([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in clash.collect()], want)
    assert {(r._d, r._T, r._drop) for r in clash.collect()} == {(1, 2, 3)}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_counts_documents(spark):
    """Repeated rows are one document, whether their texts agree or not."""
    rows = [(1, LONG)] * 4 + [(2, LONG)]
    rows += [(3, f"{LONG} b\n{k}") for k in range(5)] + [(4, f"{LONG} b")]
    rows += [(k, f"{LONG} c\n{LONG} c") for k in range(5)] + [(4, f"x\n {LONG.upper()} C\t"), (None, f"{LONG} c"), (None, f"{LONG} d")]
    rows += [(-7, f"{LONG} e"), (-8, f"{LONG} e"), (None, f"{LONG} e"), (None, f"{LONG} e"), (-9, f"{LONG} e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(docs).collect()]
    want = brute.line_dedup(rows)
    assert brute.same_rows(got, want)
    assert all(w[2] == 0 for w in want if w[0] in (1, 2) and LONG == w[3])


# ---------------------------------------------------------------- 5


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁\n\tabcething.,1é日😀\x00<s>")), max_size=40))
def test_prefix_counts(sp, s):
    c = token_counts.counter(token_counts.default_model())
    assert c.all_prefixes(s).tolist() == [len(sp.encode(s[:k])) for k in range(len(s) + 1)]
    assert c.all_prefixes(s)[-1] == len(sp.encode(s))


def test_token_counts_query(spark, odd, sp):
    docs, rows = odd
    got = token_counts.count_tokens(docs, limit=100).collect()
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for d, t in rows]
    assert brute.same_rows([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], want)
    texts = {d: t or "" for d, t in rows if d not in {x for x, n in Counter(d for d, _ in rows).items() if n > 1}}
    for r in got:
        if r.doc_id in texts:
            t, k = texts[r.doc_id], r.chars_within
            assert (k == len(t)) == (not r.over_limit) and len(sp.encode(t[:k])) <= 100
            assert all(len(sp.encode(t[:j])) > 100 for j in range(k + 1, min(len(t), k + 40) + 1))
    assert set(got[0].asDict()) == {*docs.columns, "n_bytes", "n_tokens", "over_limit", "chars_within"} - {"text"}
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS _steps", "2 AS prefix_steps", "3 AS n_chars")
    assert {r._steps for r in token_counts.count_tokens(clash).collect()} == {1}
    store = token_counts.store_counts(frame(spark, ["the thing is here", "  two  spaces ", None]))
    asked = store.select(
        "doc_id", token_counts.tokens_upto("prefix_steps", F.lit(9)).alias("a"), token_counts.chars_within("prefix_steps", F.lit(2)).alias("b"),
        token_counts.tokens_upto("prefix_steps", F.lit(0)).alias("z"), token_counts.prefix_counts("prefix_steps").alias("c"),
    )
    for r in asked.collect():
        t = ["the thing is here", "  two  spaces ", ""][r.doc_id]
        assert list(r.c) == [len(sp.encode(t[:k])) for k in range(len(t) + 1)] and r.z == 0
        assert r.a == len(sp.encode(t[:9])) and r.b == max(k for k in range(len(t) + 1) if r.c[k] <= 2)


# ---------------------------------------------------------------- 6


def test_simhash(spark, odd):
    docs, rows = odd
    rng = np.random.default_rng(0)
    more = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 30)) for _ in range(60)]
    more += [m + " aa" for m in more[:20]] + more[:10]
    docs = docs.unionByName(frame(spark, more, range(1000, 1000 + len(more))))
    rows = rows + list(zip(range(1000, 1000 + len(more)), more))
    want = brute.simhash_components(rows)
    for cap in (4096, 4):
        got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bucket_cap=cap).collect()]
        assert brute.same_rows(got, want)
    clash = docs.selectExpr("*", "1 AS _fp", "2 AS fingerprint", "3 AS component_id", "4 AS light", "5 AS _id", "6 AS _n")
    got = simhash.near_duplicates(clash, most_heavy=10).collect()
    assert brute.same_rows([(r.doc_id, r.fingerprint, r.component_id) for r in got], want) and {(r._fp, r._id, r._n) for r in got} == {(1, 5, 6)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_full_buckets():
    """Full buckets of dense fingerprints take memory in proportion to their rows."""
    import tracemalloc

    bucket = np.repeat(np.arange(6), 4096)
    fp = np.concatenate([np.random.default_rng(k).permutation(4096).astype(np.uint64) | np.uint64(k << 20) for k in range(6)])
    tracemalloc.start()
    u, v = simhash._links(bucket, fp, 3)
    assert tracemalloc.get_traced_memory()[1] < 60 * 8 * len(fp)
    tracemalloc.stop()
    assert len(u) == 6 * 4095 and len(set(v.tolist())) == 6


def test_pigeonhole_finds_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = list(base)
    for b in base[:30]:
        fps += [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for n in (1, 2, 3, 4)]
    fps += [base[0] ^ np.uint64(k) for k in range(1 << 9)]  # a dense corner
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = {}
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = find(i), find(int(j))
        root[max(a, b)] = min(a, b)
    for i in range(len(fps)):
        want.setdefault(find(i), set()).add(int(fps.view(np.int64)[i]))
    for cap in (4096, 16):
        got = {}
        for r in components.components(simhash.near_links(df, 3, cap)).collect():
            got.setdefault(r.root, set()).add(r.node)
        assert {frozenset(s) for s in want.values() if len(s) > 1} == {frozenset(s) for s in got.values()}


def test_near_duplicate_texts(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    base = [[word() for _ in range(200)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for at in (20, 60, 100):
            texts.append(" ".join(b[:at] + [word()] + b[at + 1 :]))
    texts += texts[:3] + [None, "", " "]
    docs = frame(spark, texts)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [*range(12), 33]
    twice = docs.unionByName(docs)
    assert simhash.drop_near_duplicates(twice).count() == 13
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def kept_texts(texts, least=0.8, size=5):
    """Ids that stay by brute force: the first of every component of texts alike; and the similarities of pairs over 0.5."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))})
    root, found = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            if (same := len(sets[i] & sets[j])) * 3 > len(sets[i]) + len(sets[j]):
                found.append(same / (len(sets[i]) + len(sets[j]) - same))
                if found[-1] >= least and root[i] != root[j]:
                    lo, hi = sorted((root[i], root[j]))
                    root = [lo if r == hi else r for r in root]
    return sorted(set(root)), found


def template_texts(n):
    """Texts of one template and words of their own, about 0.7 alike, and after them a copy of each, over 0.8 alike."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    template = [word() for _ in range(250)]
    base = [[*template, *[word() for _ in range(50)]] for _ in range(n)]
    return [" ".join(b) for b in base] + [" ".join([*b[:at], word(), *b[at + 1 :]]) for b in base for at in [int(rng.integers(5, 245))]]


def test_near_duplicates_in_hot_buckets(spark):
    texts = template_texts(120)
    want, found = kept_texts(texts)
    assert want == list(range(120)) and sum(s < 0.8 for s in found) > 20_000
    for how in ({"bucket_cap": 16}, {"most_shingles": 9_000}, {}):
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, texts), **how).collect()) == want


def test_near_duplicates_at_the_limit(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(104)] for _ in range(400)]
    copies = [[word() if k in (20, 70) else w for k, w in enumerate(b)] for b in base]
    texts = [" ".join(t) for t in base + copies]
    want, found = kept_texts(texts)
    assert len(found) == 400 and all(0.8 <= s < 0.85 for s in found) and want == list(range(400))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, texts)).collect()) == want


def test_near_duplicates_beside_nearer_texts(spark):
    texts = template_texts(300)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, texts)).collect()) == list(range(300))


def test_near_duplicates_by_fingerprints(spark, monkeypatch):
    """Texts within three bits are found by their fingerprints alone."""
    monkeypatch.setattr(simhash, "_file_texts", lambda batches: iter(()))  # no bucket of min-hashes
    rng = np.random.default_rng(10)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 3000)] for _ in range(20)]
    copies = [[*b[:-1], "changed"] for b in base]
    fp = lambda w: simhash.fingerprint(simhash.shingle_hashes([x.encode() for x in w], 3))
    near = [(fp(a) ^ fp(b)).bit_count() <= 3 for a, b in zip(base, copies, strict=True)]
    assert sum(near) >= 10
    texts = [" ".join(t) for t in base + copies]
    got = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, texts)).collect()}
    assert got == {*range(20), *(20 + k for k, n in enumerate(near) if not n)}


# ---------------------------------------------------------------- 7


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(900 + k, rows[k][1]) for k in range(30)]  # ties
    rows += [(400, None), (450, []), (500, [float("nan")] * 8), (550, [1.0, None] + [0.0] * 6), (600, [float("inf")] * 8), (None, [1.0] * 8), (650, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, extra int".replace(", extra int", ""))
    sound = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 50 == 0:
            best = sorted([(-int(v @ w), i) for i, w in sound if i != q and len(w) == len(v)])[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard, block, job in ((8192, 8192, 16), (40, 3, 2), (7, 8192, 1)):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_rows=block, shards_a_job=job).collect()
        assert brute.same_rows([tuple(r) for r in got], want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    clash = df.selectExpr("vec_id", "embedding", "1 AS id", "2 AS v", "3 AS row", "4 AS query", "5 AS path")
    assert topk.top_k(clash, F.col("vec_id") % 50 == 0).count() == len(want)


def nearest(rows, k=5, every=50):
    """(query id, rank, id, score) by brute force in whole numbers; every row but the query's own is a candidate."""
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = []
    for a, (q, v) in enumerate(whole):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(whole) if a != b and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_topk_repeated_ids_and_large_values(spark):
    rng = np.random.default_rng(5)
    rows = [(50, [1.0, 0.0]), (51, [1.0, 0.0]), (50, [5.0, 0.0]), (50, [5.0, 0.0])]
    rows += [(k, [float(x) for x in rng.normal(size=3)]) for k in range(100)] + [(k, [0.0] * 3) for k in (0, 7)]
    rows += [(200 + k, [float(x) for x in rng.normal(size=4) * 2.0**k]) for k in range(50)]  # up to 2^57 in whole numbers
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    fits = [(i, [x / 2**32 if len(v) == 4 else x for x in v]) for i, v in rows] + [(300, [1e13, 1.0]), (301, [2.0**-8, 0.0]), (350, [-1e15, 2.0**-8, 0.0, 0.0, 0.0]), (351, [0.01, 2.0, 3.0, 4.0, 2.0**30])]
    df = spark.createDataFrame(fits, "vec_id long, embedding array<double>")
    for shard in (8192, 3):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard).collect()
        assert brute.same_rows([tuple(r) for r in got], nearest(fits))


def test_topk_bounds_prune(spark):
    """Skewed impacts let the bounds stop early, and no member is lost."""
    rng = np.random.default_rng(6)
    v = np.floor(256 * rng.normal(size=(3000, 32)) * np.exp(rng.normal(size=(3000, 1)) * 2))
    index = topk.ImpactIndex.load(topk.ImpactIndex(np.arange(3000), np.arange(3000) * 3, v).save())
    member = index.candidates(v[:100], np.arange(100) * 3, 5, np.full(100, -np.inf))
    assert member.mean() < 0.05
    for j in range(100):
        score = v @ v[j]
        score[j] = -np.inf
        assert member[np.argsort(-score, kind="stable")[:5], j].all()


# ---------------------------------------------------------------- 8


@pytest.fixture(scope="module")
def tk():
    import tiktoken

    e = byte_bpe.encoder(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    return e, tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=e.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet=st.sampled_from(list(" \n\t'slmaé²Ⅷ日\x1c\x85\xa01.,")), max_size=40))
def test_bpe(tk, s):
    (text, ids), = tk[0].encode_texts([s])
    assert ids.tolist() == tk[1].encode_ordinary(s)
    assert tk[0].decode(ids) == s.encode() and text == ",".join(map(str, ids))


def test_bpe_long_pieces(tk):
    for s in ("a" * 3000, "ab" * 700, " " * 1000, "日本" * 500, "thequickbrownfox" * 100):
        (_, ids), = tk[0].encode_texts([s])
        assert ids.tolist() == tk[1].encode_ordinary(s)


def test_bpe_query(spark, odd, tk):
    docs, rows = odd
    got = byte_bpe.encode_digests(docs, with_ids=True)
    want = [(d, len(i := tk[1].encode_ordinary(t or "")), brute.sha(",".join(map(str, i))), brute.sha(t or ""), tuple(i)) for d, t in rows]
    assert brute.same_rows([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got.collect()], want)
    back = docs.withColumn("b", byte_bpe.decode_column(byte_bpe.encode_column(F.coalesce("text", F.lit("")))))
    assert all(bytes(r.b).decode() == (r.text or "") for r in back.collect())
    assert byte_bpe.encode_digests(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 9


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 300), st.sampled_from([1, 2, 50, 65536]), st.integers(0, 99))
def test_coder(lanes, n, most, seed):
    ids = np.random.default_rng(seed).integers(0, most, (lanes, n)).astype(np.int32)
    assert (id_files.decode_blocks(id_files.encode_blocks(ids, 16), n, 16) == ids).all()


@pytest.mark.parametrize("bits,n,low,high", [(20, 900, 0, 1 << 20), (16, 700, 65_000, 1 << 16), (1, 300, 0, 2), (18, 2100, 200_000, 200_040)])
def test_coder_widths(bits, n, low, high):
    """Ids of other widths; runs of one id; lanes that differ; lengths about the renewals of order 0."""
    rng = np.random.default_rng(bits)
    ids = rng.integers(low, high, (6, n)).astype(np.int32)
    ids[0] = ids[0, 0]
    ids[1] = np.resize(ids[1, :7], n)
    for k in (1, 15, 16, 17, n):
        assert (id_files.decode_blocks(id_files.encode_blocks(ids[:, :k], bits), k, bits) == ids[:, :k]).all()
    with pytest.raises(ValueError, match="bits"):
        id_files.encode_blocks(ids + (1 << bits), bits)


def test_coder_mixes(spark):
    """On blocks of real ids the mixture needs less than zlib on the same blocks; weights follow what predicts."""
    texts = [r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").collect()]
    enc = id_files.encoder(id_files.default_tokenizer())
    ids = np.concatenate([np.append(x, 2) for x in enc.texts(texts)]).astype(np.int32)
    n = id_files.BLOCK
    blocks = ids[: len(ids) // n * n].reshape(-1, n)
    size = 4 * sum(map(len, id_files.encode_blocks(blocks, 16)))
    assert len(blocks) > 50 and size < 0.95 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    m = id_files._Model(1, 64, 16)
    below = count = np.zeros(1, np.int64)
    for x in [3, 9] * 40:  # what order 1 and 2 predict without fail
        m.predict()
        _, width = m.place(np.array([x]), below, count)
        m.learn(np.array([x]), width.astype(np.int64))
    m.predict()
    assert int(m.m2[0] + m.m1[0]) > 0.8 * 2.0 ** int(m.scale)


def test_id_bits_follow_the_vocabulary(spark):
    assert id_files.vocabulary(id_files.default_tokenizer()) == 50_257
    with pytest.raises(ValueError, match="16 bits"):
        id_files.write_ids(frame(spark, ["a"]), id_bits=15)
    wide = id_files.read_ids(id_files.write_ids(frame(spark, ["a b", None]), end_id=70_000)).collect()
    assert sorted(r.ids[-1] for r in wide) == [70_000, 70_000]


def test_id_files(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    docs, rows = odd
    lib = Tokenizer.from_file(id_files.default_tokenizer())
    got = id_files.read_ids(id_files.write_ids(docs, file_ids=5000)).orderBy("start").collect()
    by, at, last = {}, 0, None
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert last is None or (r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
        by.setdefault(r.doc_id, []).append(tuple(r.ids))
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append((*lib.encode(t or "", add_special_tokens=False).ids, 2))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert id_files.read_ids(id_files.write_ids(docs.limit(0))).count() == 0


def test_encoder_by_words():
    """Words encoded many at a time give the library's ids, wherever white space stands; a small memo loses none."""
    enc = id_files.Encoder(id_files.default_tokenizer(), memo=20)
    odd = ["", None, " ", " a", "a ", "a  b", "a\n b", "a\nb c\n", "x\n\n", "<|endoftext|> a b", "a\u3000 b", "b c\u3000", "a\tb c\t", "it's don't", "\u00e9 \u6f22\u5b57", "a\x1c b", "c d\x0b", " \n"]
    texts = [*odd, *[" ".join(f"w{k * j}" for j in range(k)) for k in range(60)]]
    want = [e.ids for e in enc.lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        assert [x.tolist() for x in enc.texts(texts)] == want
    assert [x.tolist() for x in enc.texts(pa.array(texts[::-1]))] == want[::-1]


def test_blocks_learn_together():
    """What one block shows, the others predict: blocks of the same random ids cost little beside one of them."""
    ids = np.random.default_rng(5).integers(0, 50_000, (1, 1200)).astype(np.int32)
    turned = np.concatenate([np.roll(ids, 40 * k, axis=1) for k in range(30)])
    one, all_ = (sum(map(len, id_files.encode_blocks(x, 16))) for x in (ids, turned))
    assert all_ < 0.3 * 30 * one
    words = id_files.encode_blocks(turned, 16)
    assert (id_files.decode_blocks(words, 1200, 16) == turned).all()
    words[0] = words[0].copy()
    words[0][3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        id_files.decode_blocks(words, 1200, 16)


def test_id_file_damage(tmp_path):
    import pyarrow.fs as fs

    local, path = fs.LocalFileSystem(), str(tmp_path / "x.ids")
    w = id_files.Writer(local.open_output_stream(path))
    ids = np.arange(20_000, dtype="<u4") % 700
    w.add(1, ids)
    w.add(2, ids[:3])
    w.close()
    assert [(d, i.tolist()) for d, i in id_files.read_file(local.open_input_file(path))] == [(1, ids.tolist()), (2, [0, 1, 2])]
    raw = bytearray(open(path, "rb").read())
    raw[300] ^= 255
    open(path, "wb").write(bytes(raw))
    with pytest.raises(ValueError):
        list(id_files.read_file(local.open_input_file(path)))


# ---------------------------------------------------------------- 10


def test_toxicity_held_out(spark):
    """Floors on the labelled rows of a given table that the fit does not see; repeated rows and clashing columns."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in common.table(spark, d, "labels").filter("toxic IS NOT NULL").collect()}
    got = [r for r in toxicity.op10_toxicity(spark, d).filter("held_out").collect() if r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in got])
    p, said = np.array([r.score for r in got]), np.array([r.predicted for r in got])
    assert len(got) > 500 and brute.auc(p, y) >= 0.95 and (said == y).mean() >= 0.97
    assert said[y == 1].mean() >= 0.9 and y[said == 1].mean() >= 0.9


def best_segments(s):
    """All maximal scoring segments by their definition: take the best, then left and right of it."""
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9 or abs(total - best[0]) <= 1e-9 and j + 1 - i < best[2] - best[1]):
                    best = (total, i, j + 1)
        if best:
            split(a, best[1])
            out.append((best[1], best[2], best[0]))
            split(best[2], b)

    split(0, len(s))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.75, 2.0, 4.25]), max_size=14))
def test_maximal_segments(s):
    sc = toxicity.Scorer(toxicity.Model())
    words = [str(k).encode() for k in range(len(s))]
    got = sc.passages(words, dict(zip(words, s)))
    want = best_segments(s)
    assert sum(v for _, _, v in got) == pytest.approx(sum(v for _, _, v in want))
    assert sorted(v for _, _, v in got) == pytest.approx(sorted(v for _, _, v in want))


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = ["w%d" % k for k in range(60)]
    rows, labels = [], []
    for d in range(600):
        t = list(rng.choice(words, 40))
        bad = d % 5 == 0
        if bad:
            for k in rng.integers(5, 35, 3):
                t[k] = rng.choice(["vile", "foul", "rotten"])
        rows.append((d, " ".join(t)))
        labels.append((d, int(bad)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "vile foul"), (902, "vile foul " + "w1 " * 20000)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).withColumn("ho", toxicity.held_out("doc_id")).collect()}
    held = [d for d in range(600) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].ho == (d in set(held)) for d in range(600))
    assert np.mean([got[d].predicted == labels[d][1] for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[900].predicted == got[901].predicted == 0 and got[None].predicted == 1
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} <= {0, 1}


# ---------------------------------------------------------------- shared


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (4, 1), (20, 10)] + [(100 + k, 101 + k) for k in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 10, **{100 + k: 100 for k in range(51)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shared_dir(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
