"""Session defaults, and making the package importable on workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with UTC times, adaptive execution with skew handling, and Arrow transfer."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: Workers live through many stages: memory that a stage gives back returns to the system.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}
#: Rows of an Arrow batch: rows here are whole documents or blocks of a recording, far above a number in size.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Let Python workers on machines that see this folder import the package, and bound their memory.

    On clusters without a shared folder, pass the package with --py-files.
    """
    env = spark.sparkContext.environment
    for k, v in WORKER_MEMORY.items():
        env.setdefault(k, v)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; on one machine without it, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="voltloom-shared-")
    return f"{base.rstrip('/')}/voltloom-{name}-{uuid.uuid4().hex}"


def materialized_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has given when all that is there now has been read; tasks write it to the shared folder.

    In complete mode every batch replaces the table, so the last one stays.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")
    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
