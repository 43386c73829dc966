"""The pipeline's rows against plain versions of its stages, over a whole small table."""

import re

import brute
import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def near_kept(rows, least=0.8, size=5):
    """doc_ids that stay: the smallest of every component of texts alike."""
    sets = []
    for _, t in sorted(rows):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(brute._LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else {()})
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and (same := len(a & b)) >= least * (len(a) + len(b) - same) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    ids = sorted(d for d, _ in rows)
    return {ids[r] for r in root}


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == columns
    kept = [(r.doc_id, r.text) for r in clean.collect()]
    assert kept and all(rows[d] == t for d, t in kept)
    # an untouched text stays as it was, null or not
    lined = [(d, t if not gone else new) for (d, t), (_, _, gone, new) in zip(kept, brute.line_dedup(kept), strict=True)]
    assert any(a != b for a, b in zip(kept, lined, strict=True))
    near = near_kept(lined)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    last = {d: t for d, t in lined if d in near}
    last = {d: last[d] for d, *_, hit in brute.contamination(list(last.items()), items) if not hit}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(near) < len(lined) and len(last) < len(near)
    assert got == {d: brute.sha(t or "") for d, t in last.items()}


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, passages string, n_tokens long, kept string, _k string, doc_key string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, one id with two texts, a very long text, a benchmark passage, columns that clash."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = [(None, None), (None, "some text"), (1, ""), (1, ""), (2, None), (3, "a b c"), (3, "another text"), (4, "word " * 200_000), (5, f"before {item} after"), (6, "\n \t"), (5, "clean"), (None, "some text"), (7, "😀é日本")]
    return spark.createDataFrame([(d, t, "en", None, None if t is None else len(t), 0.5, 1, "p", 3, "k", "x", "y") for d, t in texts], ODD), texts


def test_stages_on_odd_rows(spark, odd):
    docs, texts = odd
    columns = list(corpus_pipeline.COLUMNS)
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == columns and brute.same_rows([(r.doc_id, r.text) for r in clean.collect()], texts)
    free = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert free.columns == columns and brute.same_rows([(r.doc_id, r.text) for r in free.collect()], [x for x in texts if not (x[0] == 5 and x[1] != "clean")])
    merged = corpus_pipeline.drop_contaminated(spark, docs, SF, broadcast_rows=0)
    assert brute.same_rows(map(tuple, merged.collect()), map(tuple, free.collect()))
    lines = corpus_pipeline.drop_shared_lines(spark, docs, SF)
    assert lines.columns == columns and brute.same_rows([(r.doc_id, r.text, r.n_chars) for r in lines.collect()], [(d, t, None if t is None else len(t)) for d, t in texts])
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    left = {r.text for r in near.collect()}
    assert near.columns == columns and left >= {"some text", "a b c", "another text", "clean", "😀é日本"} and near.count() == len(left) and len(left & {None, "", "\n \t"}) == 1
    encoded = corpus_pipeline.encode(spark, docs, SF)
    assert brute.same_rows([(r.doc_id, r.decoded_sha256) for r in encoded.collect()], [(d, brute.sha(t or "")) for d, t in texts])
