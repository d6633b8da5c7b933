"""Connected components of a graph given as a table of edges, by alternating star contractions.

Every round is two aggregations and two joins; a hub of any degree is pre-aggregated before the shuffle, and
its neighbours are kept out of the join's shuffle. No neighbour list is ever collected.

Edges that were counted to be at most FEW_EDGES go through one task instead: rounds over few rows cost the driver more
plans, threads and memory than the executors work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import label_join, lean, materialise, release
from inkfold.llm.runs import column
from inkfold.operators.kernels import roots

#: One task takes so many edges (8 MB, and some ten times that while it works).
FEW_EDGES = 500_000


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge, and none of the v is a u. All edges have u > v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v"))
    )
    bad = ends.groupBy("x").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("hub"))
    return bad.where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("hub") > 0))).isEmpty()


def _of_few(edges: DataFrame) -> DataFrame:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack((column(b, "u"), column(b, "v"))) for b in batches]
        if not held:
            return
        ids, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        yield pa.record_batch([pa.array(ids), pa.array(ids[roots(len(ids), u, v)])], names=["id", "component"])

    return edges.coalesce(1).mapInArrow(lean(label), "id long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """edges (a long, b long) -> (id long, component long), a row for each vertex with a neighbour.

    component is the smallest id reachable. Loops and null ends are ignored; directions and repeats don't
    matter. Vertices without an edge to another one aren't in the result.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if now.count() <= few:
        return _of_few(now)
    for _ in range(max_rounds):
        if _is_forest_of_stars(now):
            break
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            now.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = materialise(
            both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("copies")).select("x", F.least("x", "m").alias("m"), "copies")
        )
        # Large star: every larger neighbour is tied to the least vertex around x, which may have very many.
        large = label_join(both.where("y > x"), least, ["x"]).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        held, least = least, large.groupBy("u").agg(F.min("v").alias("m"))
        # Small star: the smaller neighbours of u, and u itself, are tied to the least of them.
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        then = materialise(small)
        release(now)
        release(held)
        now = then
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
