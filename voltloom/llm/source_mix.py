"""Operator 13: a mix of sources at target weights, by hash thresholds.

A document's size is its number of words.  Sources, in code point order with
null last, get weights in turn; together they share ``share`` times all sizes.
A target stops at ``most`` times its source's size and the excess is shared
again by weight until none is above (``targets``).

A source's documents are all taken as often as its target holds them whole;
what is left of the target goes, once more, to the documents whose hash lies
under a threshold.  Sizes are summed by source and hash bucket, the running
sums of a source's buckets give the bucket in which the budget ends, and only
the documents of that bucket are summed again under the next bits of the hash,
until the bucket holds one document.  Then rows are filtered by comparing their
hash with the threshold: no document is sorted.  As a smaller share has a lower
threshold in every source, its mix is a part of a larger share's, but for one
document a source: the gap to the target under the threshold goes to the
document beyond it that fills it best.

No group of rows meets in a task: sums are combined map-side, a source has at
most 4 096 buckets a round, and the table of sources is ranked by ranges.

Defined results: a null or empty text has size zero; a null source is a source
of its own, after all others; rows that agree in id and size share a hash, and
their row numbers go on where the hash ends, so a group of copies is cut
anywhere and reruns give the same rows; a null id is an id; sources of size
zero have target zero; an empty table gives an empty result.  Other columns are
left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits and row numbers, twelve bits a round.
ROUNDS = [("h", s) for s in (48, 36, 24, 12, 0)] + [("row", s) for s in (60, 48, 36, 24, 12, 0)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, s, size, h, row): ``s`` orders sources, ``h`` are 60 bits of a hash of id and size, ``row`` a number of the row."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("s"),
        word_count(F.col(text_col)).alias("size"),
    )
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string"))
    bits = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    return common.materialize(sized.withColumns({"h": bits, "row": F.monotonically_increasing_id()}), "mix-sizes")


def targets(sized: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """(s, source_size, target, base, rest): words a source should give, as whole passes over it and what is left."""
    spark = sized.sparkSession
    sums = sized.groupBy("s").agg(F.sum("size").alias("source_size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = common.materialize(sums.repartitionByRange(parts, "s").withColumn("p", F.spark_partition_id()), "mix-sources")
    before = sums.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("s")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    ranked = common.materialize(sums.join(F.broadcast(before.select("p", "before")), "p").select("s", "source_size", weight.alias("w")), "mix-weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # the level rises until no further source is above its cap
        above = F.lit(level) * F.col("w") > cap
        r = ranked.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("w")))).first()
        if r[0] == capped or r[2] is None:
            break
        capped, level = r[0], (total * share - (r[1] or 0.0)) / r[2]
    target = F.least(cap, F.lit(level) * F.col("w"))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("long")
    return ranked.withColumn("target", target).withColumn("base", base).withColumn("rest", rest).drop("w")


def _beside(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", broadcast_rows: int = 200_000) -> DataFrame:
    """Join a table of one row a source: sent to every task if counted few, else by sort and merge, which splits hot sources."""
    return rows.join(F.broadcast(small) if small.count() <= broadcast_rows else small.hint("merge"), on, how)


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(s, at_h, at_row, gap): the document at which a source's rest ends, and the words that those under it leave."""
    open_ = goals.filter("rest > 0").select("s", F.col("rest").alias("gap"))
    inside = sized.filter("size > 0").select("s", "size", "h", "row")
    for kind, shift in ROUNDS:
        bucket = F.shiftrightunsigned(kind, shift)
        summed = inside.withColumn("b", bucket).groupBy("s", "b").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "row")).alias("first"))
        run = summed.withColumn("under", F.sum("words").over(Window.partitionBy("s").orderBy("b")) - F.col("words"))
        edge = _beside(run, open_, ["s"]).filter((F.col("under") <= F.col("gap")) & (F.col("gap") < F.col("under") + F.col("words")))
        edge = common.materialize(edge.select("s", "b", (F.col("gap") - F.col("under")).alias("gap"), "n", "first"), "mix-edges")
        open_ = edge.select("s", "gap")
        if (edge.agg(F.max("n")).first()[0] or 1) == 1:
            break
        inside = common.materialize(_beside(inside.withColumn("b", bucket), edge.select("s", "b"), ["s", "b"]).drop("b"), "mix-inside")
    return edge.select("s", F.col("first.h").alias("at_h"), F.col("first.row").alias("at_row"), "gap")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): how often the mix takes each document."""
    sized = document_sizes(docs, id_col, text_col, source_col)
    goals = common.materialize(targets(sized, share, weights, most), "mix-targets")
    at = thresholds(sized, goals)
    # the document at or beyond the threshold that comes nearest to the gap, if any comes nearer than none
    beyond = (F.col("h") > F.col("at_h")) | ((F.col("h") == F.col("at_h")) & (F.col("row") >= F.col("at_row")))
    off = F.abs(F.col("size") - F.col("gap"))
    fill = _beside(sized.filter("size > 0"), at, ["s"]).filter(beyond & (off < F.col("gap"))).groupBy("s").agg(F.min(F.struct(off.alias("off"), "h", "row")).alias("fill"))
    plan = common.materialize(goals.join(at, "s", "left").join(fill, "s", "left"), "mix-plan")
    joined = _beside(sized, plan, ["s"])
    more = F.coalesce(~beyond, F.lit(False)) | F.coalesce((F.col("h") == F.col("fill.h")) & (F.col("row") == F.col("fill.row")), F.lit(False))
    copies = F.col("base") + F.when(F.col("size") > 0, more.cast("long")).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).drop("copies")
