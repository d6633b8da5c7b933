"""What several operators share: tables in the shared folder, sized joins, UTF-8 sizes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.plans.shared import BROADCAST_ROWS, label_join, materialise, release, rest_executors, sized_join

__all__ = ["BROADCAST_ROWS", "fresh", "in_parts", "label_join", "lean", "materialise", "octets", "release", "rested", "settle", "sized_join", "small_batches", "table", "trim"]


#: An Arrow batch has about so many bytes at most.
ARROW_BYTES = 4 << 20


def octets(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow step that gives its memory back to the system: Spark keeps its process for a minute or the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        yield from step(batches)
        settle()

    return run


def small_batches(spark: SparkSession) -> None:
    """Lets the session send Arrow batches of at most ARROW_BYTES, unless it has a setting of its own. The default of 64 MB is
    held several times for each step of a task, in the JVM and in Python. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(key, ARROW_BYTES)


def in_parts(batches: Iterator[pa.RecordBatch], name: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts with about so many bytes in a column of texts or bytes, so that little is held at once."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b[name]), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def settle() -> None:
    """Gives what is free back to the system, now and for Arrow from now on."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim()


def trim() -> None:
    """Gives what is free back to the system."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def rested(spark: SparkSession) -> None:
    """Between stages: what is free goes back to the system from the driver's Python, whose dropped tables hold their plans
    in its JVM, from that JVM and from the executors' JVMs."""
    gc.collect()
    trim()
    spark._jvm.java.lang.System.gc()
    rest_executors(spark)
