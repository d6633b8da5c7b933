"""Near-duplicate vectors by p-stable hashing (Euclidean LSH) and exact cosine checks.

Normalised vectors are projected on random Gaussian directions; ``floor((projection + shift) / width)`` of
``bits`` directions make one bucket key, and there are ``tables`` such keys for each vector. Vectors that
share a key in some table are compared by their exact cosine in double precision, in blocks, so that no
pair of vectors is ever a row: a task returns the number of links of each vector and a star of edges for
each of its local components, which is enough for exact link counts and components.

Equal vectors are one vertex with a number of copies. A bucket of more than ``block`` vectors is dealt as
pairs of blocks to different tasks. A pair that shares several keys is counted in the first such table.

``bits`` and ``tables`` follow from the table where they aren't given: of n distinct vectors, bits are as many as leave a
vector about ``CHANCE`` unrelated ones in a bucket, and tables as many as let a pair at the threshold share a key with
probability ``recall``, closer ones more surely. So the candidates of a vector grow as a small power of n.

Nulls: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different
lengths never link. Rows with a null id link with nothing. Rows of one id are one vertex: their vectors, if sound, have
one component. Repeated rows are rows, linked with each other. Other columns aren't read, so their names don't
matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.llm.common import label_join, lean, materialise, sized_join, small_batches
from inkfold.llm.components import connected_components
from inkfold.llm.runs import column, fixed_binary, key_runs, run_starts


#: Unrelated vectors that a bucket may hold on the average, besides those that are near.
CHANCE = 40


def meeting(distance: float, width: float) -> float:
    """The probability that two vectors at this Euclidean distance lie in one cell of one direction."""
    c = width / distance
    return 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(n: int, threshold: float, width: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n distinct vectors."""
    near, apart = meeting(math.sqrt(2 - 2 * min(threshold, 1 - 1e-9)), width), meeting(math.sqrt(2), width)
    bits = max(4, math.ceil(math.log(max(n, 1) / CHANCE) / -math.log(apart))) if n > CHANCE else 4
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - near**bits))


def _hash(vectors: np.ndarray, dim: int, tables: int, bits: int, width: float, seed: int) -> np.ndarray:
    """Bucket keys, shape (vectors, tables). vectors are normalised."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((dim, tables * bits))
    shifts = rng.uniform(0, width, tables * bits)
    mix = rng.integers(1, 2**62, bits, dtype=np.int64) * 2 + 1
    cells = np.floor((vectors @ directions + shifts) / width).astype(np.int64).reshape(-1, tables, bits)
    keys = (cells * mix).sum(axis=2)
    return keys ^ (keys >> 29)


def normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _local_roots(links: np.ndarray) -> np.ndarray:
    """The least index reachable in a symmetric boolean matrix of links."""
    n = len(links)
    root = np.arange(n)
    links = links | np.eye(n, dtype=bool)
    while True:
        least = np.where(links, root[None, :], n).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    threshold: float = 0.95,
    tables: int | None = None,
    bits: int | None = None,
    recall: float = 0.998,
    width: float = 1.2,
    block: int = 2048,
    seed: int = 20,
) -> DataFrame:
    """A row for each row of df: id, n_links long, component_id long, kept boolean."""
    small_batches(df.sparkSession)
    # Floats are sent as floats, which holds them exactly.
    kind = df.schema[vector_col].dataType
    sent = np.float32 if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else np.float64
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = (
        F.col("id").isNotNull()
        & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    # -0.0 and 0.0 are equal vectors.
    rows = materialise(
        rows.select("id", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))).alias("v")).withColumn(
            "key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json("v"), 256))
        )
    )
    sound_rows = rows.where("v is not null")
    classes = sound_rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # Numbered as they are written, so the numbers are fixed.
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()))
    planned = plan(classes.count(), threshold, width, recall)
    bits = planned[0] if bits is None else bits
    if tables is None:
        tables = planned[1] if bits == planned[0] else math.ceil(math.log(1 - recall) / math.log(1 - meeting(math.sqrt(2 - 2 * threshold), width) ** bits))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = pc.list_value_length(b["v"]).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                yield from of_length(b.filter(pa.array(dims == dim)), dim)

    def of_length(b: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
        x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        keys = _hash(normalised(x), dim, tables, bits, width, seed)
        raw, all_keys = [r.tobytes() for r in x.astype(sent)], [r.tobytes() for r in keys]
        step = max(1, 20_000 // tables)
        for lo in range(0, b.num_rows, step):
            hi = min(b.num_rows, lo + step)
            at = np.repeat(np.arange(lo, hi), tables)
            yield pa.record_batch(
                [
                    pa.array(np.full(len(at), dim, np.int32)),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), hi - lo)),
                    pa.array(keys[lo:hi].ravel()),
                    b["rep"].take(pa.array(at)),
                    b["copies"].take(pa.array(at)),
                    pa.array([raw[i] for i in at], pa.binary()),
                    pa.array([all_keys[i] for i in at], pa.binary()),
                ],
                names=["dim", "tab", "bucket", "rep", "copies", "x", "all_keys"],
            )

    buckets = classes.select("rep", "copies", "v").mapInArrow(
        lean(hashed), "dim int, tab int, bucket long, rep long, copies long, x binary, all_keys binary"
    )
    # How large each bucket is, from the keys alone; a bucket of one compares nothing.
    sizes = materialise(buckets.groupBy("dim", "tab", "bucket").count().where("count > 1"))
    wide = sized_join(buckets, sizes, ["dim", "tab", "bucket"], "inner").withColumn(
        "blocks", F.ceil(F.col("count") / block).cast("int")
    )
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    dealt = (
        wide.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .select("dim", "tab", "bucket", "lo", "hi", "own", "rep", "copies", "x", "all_keys")
    )
    keys = ["dim", "tab", "bucket", "lo", "hi"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, keys):
            starts = np.append(run_starts(rows, keys), rows.num_rows)
            dims = column(rows, "dim")
            every = fixed_binary(rows, "all_keys", np.int64, tables)
            rep, copies, side = column(rows, "rep"), column(rows, "copies"), column(rows, "own")
            tab, lo, hi = column(rows, "tab"), column(rows, "lo"), column(rows, "hi")
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                x = normalised(fixed_binary(rows.slice(a, b - a), "x", sent, int(dims[a])).astype(np.float64))
                links = x @ x.T >= threshold
                np.fill_diagonal(links, False)
                if lo[a] != hi[a]:  # pairs inside a block are compared in that block's own task
                    links &= side[a:b][:, None] != side[a:b][None, :]
                if not links.any():
                    continue
                k = every[a:b]
                fresh = links.copy()
                for t in range(tab[a]):  # a pair that met in an earlier table is counted there
                    fresh &= k[:, t][:, None] != k[:, t][None, :]
                n = fresh @ copies[a:b]
                root = _local_roots(links)
                mine = np.flatnonzero((n > 0) | (root != np.arange(b - a)))
                out.append((rep[a:b][mine], n[mine], rep[a:b][root[mine]]))
            if out:
                ids, n, roots = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.record_batch([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(roots)], names=["rep", "n", "root"])

    found = materialise(
        dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(compared), "rep long, n long, root long")
        .groupBy("rep", "root").agg(F.sum("n").alias("n"))
    )
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(_of_one_id(sound_rows, classes))
    component = materialise(connected_components(edges)).withColumnRenamed("id", "rep")
    # A component's name is the least id in it.
    names = materialise(
        component.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"), F.count("*").alias("copies"))
    )
    named = label_join(component, names, ["component"]).select("rep", "name")
    # A class with copies links its members even if no other class is near.
    labels = materialise(
        classes.select("key", "rep", "least", "copies")
        .join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        .join(named, "rep", "left")
        .select("key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("name", "least").alias("component"))
    )
    linked = label_join(sound_rows.select("id", "key"), labels, ["key"]).select("id", "n", "component")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return (
        linked.unionByName(alone)
        .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )


def _of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the vectors of one id."""
    several = materialise(rows.groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("id"))
    vectors = sized_join(rows.select("id", "key"), several, "id", "left_semi").distinct()
    vectors = materialise(sized_join(vectors, classes.select("key", "rep"), "key", "inner").select("id", "rep"))
    first = materialise(vectors.groupBy("id").agg(F.min("rep").alias("first"), F.count("*").alias("copies")))
    return label_join(vectors, first, ["id"]).where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
