"""Helpers shared by the training-data operators: tables, shared folder, caches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, one is made on a single machine (tests); on
    a cluster that would be a folder of the driver alone, so this raises.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voltloom-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voltloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again.

    Cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove materialized tables that no later step reads, through Spark's own file system layer."""
    for df in tables:
        path = df.__dict__.get("_stored")
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_names(df: DataFrame, *names: str, also: tuple = ()) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in (*df.columns, *also)}
    out = []
    for n in names:
        name = f"_{n}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def row_key(id_col: str, text_col: str) -> list:
    """Join key of a row: its id and a hash of its text, both never null.

    Rows that agree in both hold the same text under the same id, so one
    decision fits all of them; repeated ids with different texts stay apart.
    """
    return [
        F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")).alias("_k"),
        F.xxhash64(F.col(text_col)).alias("_t"),
    ]


class BatchMemo:
    """A memo of bounded size that computes missing values many at a time.

    ``make(list of keys)`` returns their values in order.  ``of(keys)`` is the
    mapping that holds at least ``keys``.  Entries live in two generations of
    half the ``limit`` each: when the young one is full it becomes the old one,
    and an old entry that is asked for again moves back.
    """

    def __init__(self, make, limit: int = 300_000):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def of(self, keys: set) -> dict:
        missing = keys.difference(self.young)
        if missing:
            if len(self.young) + len(missing) > self.limit // 2:
                self.old, self.young, missing = self.young, {}, keys
            again = missing.intersection(self.old)
            self.young.update({k: self.old[k] for k in again})
            new = list(missing.difference(again))
            self.young.update(zip(new, self.make(new), strict=True))
        return self.young


def slices(texts, most_chars: int = 2_000_000):
    """Cut a sequence of texts into runs of about ``most_chars`` characters; no text is cut."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) if t else 0
        if size >= most_chars:
            yield run
            run, size = [], 0
    if run:
        yield run
