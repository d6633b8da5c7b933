"""Components and enclosures of tables of cells, in one pass."""

import os

import numpy as np
import pyarrow as pa

from inkfold.operators import grids
from inkfold.operators import kernels as K

CELLS = "grid_id long, x int, y int"


def _tables(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    return len(os.listdir(folder)) if os.path.isdir(folder) else 0


def _snake(n):
    g = np.zeros((n, n), bool)
    g[::2] = True
    g[1::4, -1] = g[3::4, 0] = True
    return g


def _made(spark):
    rng = np.random.default_rng(5)
    made = {0: _snake(41), 1: np.zeros((3, 4), bool), 2: np.ones((1, 1), bool), **{i: rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.5 for i in range(3, 60)}}
    return made, spark.createDataFrame([(i, int(x), int(y)) for i, g in made.items() for y, x in zip(*np.nonzero(g), strict=True)], CELLS).repartition(4, "x")


def test_components_leave_no_tables_and_no_rounds(spark):
    made, cells = _made(spark)
    before = _tables(spark)
    for diagonal in (True, False):
        got = {(r.grid_id, r.x, r.y): r.label for r in grids.components(cells, diagonal).collect()}
        want = {}
        for i, g in made.items():
            label = K.labels(g, diagonal)
            for first in np.unique(label[g]):
                ys, xs = np.nonzero(label == first)
                want |= {(i, int(x), int(y)): (int(ys[0]) << 20) + int(xs[0]) for y, x in zip(ys, xs, strict=True)}
        assert got == want
    assert _tables(spark) == before  # each round left one


def test_batches_go_in_parts(monkeypatch):
    monkeypatch.setattr(grids, "HELD_CELLS", 4)
    b = pa.record_batch([pa.array(range(6)), pa.array([3, 3, 9, 0, 1, 1])], names=["grid_id", "n"])
    parts = list(grids._parts([b], lambda b: b["n"].to_numpy()))
    assert len(parts) > 2 and pa.Table.from_batches(parts).to_pylist() == b.to_pylist()
    assert not list(grids._parts([b.slice(0, 0)], lambda b: b["n"].to_numpy()))


def test_repeated_cells_and_null_grids(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 1, 1), ("b", -3, 2), ("b", -2, 2), ("b", 2**20 - 1, 1), (None, 1, 1), (None, 1, 1), (None, 2, 1), ("c", None, 1)], "grid_id string, x int, y long")
    got = sorted(map(tuple, grids.components(cells, True).collect()), key=str)
    at = 1 << 20
    assert got == sorted([("a", 0, 0, 0), ("a", 1, 1, 0), ("b", -3, 2, 2 * at - 3), ("b", -2, 2, 2 * at - 3), ("b", at - 1, 1, 2 * at - 1), (None, 1, 1, at + 1), (None, 2, 1, at + 2)], key=str)


def test_boxes_of_components(spark):
    made, cells = _made(spark)
    before = _tables(spark)
    got = sorted(map(tuple, grids.component_boxes(grids.components(cells, True)).collect()))
    want = []
    for i, g in made.items():
        label = K.labels(g, True)
        for (_, x0, y0, x1, y1), first in zip(K.boxes(label), np.unique(label[g]), strict=True):
            ys, xs = np.nonzero(label == first)
            want.append((i, (int(ys[0]) << 20) + int(xs[0]), x0, y0, x1 - x0, y1 - y0, len(xs)))
    assert got == sorted(want) and _tables(spark) == before


def test_enclosures_equal_the_kernel(spark):
    made, cells = _made(spark)
    sizes = spark.createDataFrame([(i, g.shape[1], g.shape[0]) for i, g in made.items()], "grid_id long, cols int, rows int")
    assert {r.grid_id: r.enclosures for r in grids.enclosures(cells, sizes).collect()} == {i: K.enclosures(g) for i, g in made.items()}


def test_enclosures_broadcast_no_cells(spark):
    cells = spark.createDataFrame([(1, 0, 0)], CELLS)
    sizes = spark.createDataFrame([(1, 8, 8)], "grid_id long, cols int, rows int")
    assert "Broadcast" not in grids.enclosures(cells, sizes)._jdf.queryExecution().executedPlan().toString()


def test_enclosures_of_odd_grids(spark):
    ring = [(k, x, y) for k in (1, 2) for x in range(5) for y in range(3) if not 1 <= x <= 3 or y != 1]
    sizes = spark.createDataFrame([(1, 5, 3), (2, 5, 3), (2, 5, 3), (3, 0, 4), (4, None, 4), (None, 9, 9)], "grid_id int, cols int, rows int")
    cells = spark.createDataFrame([*ring, *ring[:3], (1, 9, 1), (3, 0, 0)], "grid_id int, x int, y int")
    assert sorted(map(tuple, grids.enclosures(cells, sizes).collect()), key=str) == sorted([(1, 1), (2, 1), (2, 1), (3, 0), (4, 0), (None, 0)], key=str)
