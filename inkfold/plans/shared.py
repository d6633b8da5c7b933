"""Tables in the folder that driver and executors share, and joins whose sides are counted first."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows of a few longs (tens of MB as a hash table) may be broadcast.
BROADCAST_ROWS = 500_000
#: The keys of a join that are treated as hot have at least this share of all rows, so there are at most as many of them.
HOT_SHARE = 10_000

#: The driver's heap is asked to shrink where it has grown to this share of its limit, at most once in REST_SECONDS.
FULL_HEAP, REST_SECONDS = 0.75, 5.0
_rested = 0.0

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where neither the session nor its context names one (tests in local mode) a temporary one is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkfold-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def rest(spark: SparkSession) -> None:
    """Lets the driver's JVM give memory back. After many small jobs its heap has grown to its limit, though most of it is
    free, and the collector shrinks it only when asked."""
    global _rested
    jvm = spark._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if time.monotonic() - _rested > REST_SECONDS and runtime.totalMemory() > FULL_HEAP * runtime.maxMemory():
        jvm.java.lang.System.gc()
        _rested = time.monotonic()


def rest_executors(spark: SparkSession) -> int:
    """The same for the executors' JVMs: a task for each core. Where a stage has written its table, most of what its
    executors' heaps grew to is free, and the next stage adds to it. Returns the number of tasks."""
    n = spark.sparkContext.defaultParallelism
    asked = spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done"))
    return len(asked.collect())


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage, so that a lost executor costs its unfinished tasks only. The files go when the
    driver's Python ends, or earlier by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/inkfold-{uuid.uuid4().hex}"
    # Unlike the default codec's, its buffers don't stay with the executors.
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    rest(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkfold_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a materialise()d table that nothing reads any more."""
    path = getattr(df, "_inkfold_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def sized_join(big: DataFrame, small: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins big with a materialised small side: broadcast if small was counted to hold at most limit rows,
    else by a shuffle of both."""
    return big.join(F.broadcast(small) if small.count() <= limit else small, on, how)


def label_join(rows: DataFrame, labels: DataFrame, on: list[str], copies: str = "copies", limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows left-joined with materialised labels, of which there is one a key; copies (dropped) says how many rows have it.

    Labels are broadcast if they were counted to be at most limit. Beyond, those of hot keys still are, whose number is
    bounded by HOT_SHARE, so that no task gets a hot key's rows; the others are joined by a shuffle. Keep rows with null keys
    out of this.
    """
    bare = labels.drop(copies)
    counted = labels.agg(F.count("*").alias("n"), F.sum(copies).alias("rows")).first()
    if counted["n"] <= limit:
        return rows.join(F.broadcast(bare), on, "left")
    hot = F.col(copies) * HOT_SHARE >= F.lit(counted["rows"])
    warm = F.broadcast(labels.where(hot).drop(copies))
    rest = rows.join(F.broadcast(labels.where(hot).select(*on)), on, "left_anti").join(labels.where(~hot).drop(copies), on, "left")
    return rows.join(warm, on, "inner").unionByName(rest)
