"""Corpus cleaning in five stages, each one of the training-data operators.

The near-copy stage takes the operator's 64-bit fingerprints within three bits
and verifies their classes exactly by Jaccard similarity; min-hashes add the
similar texts that such fingerprints cannot link (``simhash.duplicates``).

Every stage reads what the one before wrote.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it.

Defined results: a null or empty text is kept by the filters as any other, and
all rows without words count as copies of one text, of which one stays;
repeated rows are copies; ties between copies go to the smallest doc_id, nulls
last, then to the least text hash; a null doc_id is an id of its own kind;
other columns of the input are left out, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm import byte_bpe, common, line_dedup, phrase_index, simhash, toxicity
from voltloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on their labels, does not reject."""
    model = toxicity.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that at least five documents share."""
    (kept,) = common.fresh_names(docs, "kept")
    out = line_dedup.dedup_lines(docs.drop("n_dropped", "n_lines"), kept_col=kept)
    changed = F.col("n_dropped") > 0
    fresh = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in COLUMNS])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = 200_000) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = phrase_index.contamination(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    names = common.fresh_names(docs, "k", "t")
    hit = found.filter("contaminated").select(F.coalesce("doc_key", F.lit("\x00")), "doc_tag").toDF(*names).distinct()
    hit = common.materialize(hit, "contaminated")
    hit = F.broadcast(hit) if hit.count() <= broadcast_rows else hit
    return docs.withColumns(dict(zip(names, common.row_key("doc_id", "text"), strict=True))).join(hit, names, "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of what they decode to."""
    return byte_bpe.encode_digests(docs.select("doc_id", "text"), with_ids=True).drop("text")


def _shipped(stage: Callable) -> Callable:
    """The stage, with the package and its limits set on the workers first, however it is called."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _shipped(drop_toxic)),
    ("line_dedup", _shipped(drop_shared_lines)),
    ("near_dedup", _shipped(drop_near_copies)),
    ("decontamination", _shipped(drop_contaminated)),
    ("byte_bpe", _shipped(encode)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage-{name}")
            common.forget(before)  # the table itself is no stored one and stays
    return docs
