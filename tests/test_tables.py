import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkfold import config
from inkfold.functions import geometry as G
from inkfold.operators import grids, layout, matching
from inkfold.operators import kernels as K
from inkfold.sources import grids as S
from inkfold.sources import templates as P


def test_rects_and_offsets(spark):
    r = G.rect(F.lit(10), F.lit(20), F.lit(30), F.lit(40))

    def b(*v):
        return G.rect(*map(F.lit, v))

    cols = {
        "center": G.point(r, "center", "center"), "top": G.point(r, "center", "top"), "low": G.point(r, "left", "bottom"),
        "from_center": G.rect_center(G.offset(F.lit(50), F.lit(60)), F.lit(30), F.lit(40)), "empty": G.is_empty(b(0, 0, 0, 0)), "line": G.is_empty(b(0, 0, 30, 0)),
        "in": G.contains_xy(r, F.lit(39), F.lit(59)), "out": G.contains_xy(r, F.lit(40), F.lit(20)), "has": G.contains_rect(r, b(15, 25, 10, 10)),
        "has_not": G.contains_rect(r, b(5, 20, 10, 10)), "meets": G.intersects(r, b(35, 55, 10, 10)), "apart": G.intersects(r, b(45, 25, 10, 10)),
        "shifted": G.shift(r, G.offset(F.lit(5), F.lit(-5))), "div": G.divide(G.offset(F.lit(6), F.lit(9)), F.lit(3)), "by_zero": G.divide(G.offset(F.lit(6), F.lit(9)), F.lit(0)),
        "none": G.intersection(r, b(100, 100, 5, 5)), "touch_v": G.intersects_vertically(r, b(0, 60, 5, 5)), "touch_h": G.intersects_horizontally(r, b(40, 20, 5, 5)),
    }
    v = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    assert tuple(v.center) == (25, 40) and tuple(v.top) == (25, 20) and tuple(v.low) == (10, 60) and tuple(v.from_center) == (35, 40, 30, 40)
    assert v.empty and not v.line and v["in"] and not v.out and v.has and not v.has_not and v.meets and not v.apart  # T18
    assert tuple(v.shifted) == (15, 15, 30, 40) and tuple(v.div) == (2, 3) and v.by_zero.x is None and tuple(v.none) == (0, 0, 0, 0)
    assert v.touch_v and not v.touch_h


def test_ascii_round_trip_and_cells(spark):
    df = spark.createDataFrame([(1, "#.#\n.#."), (2, "")], "grid_id long, t string").withColumn("grid", S.from_ascii_text(F.col("t")))
    rows = df.select("grid_id", S.to_text(F.col("grid")).alias("t"), S.to_json(F.col("grid"), F.lit("f")).alias("j"), S.to_json(F.col("grid"), F.lit("f"), True).alias("k")).orderBy("grid_id").collect()
    assert rows[0].t == "#.#\n.#." and rows[1].t == ""
    assert '"data":["#.#",".#."]' in rows[0].j and rows[0].k.count("#.#") == 6  # T3
    assert sorted(map(tuple, S.cells_of(df).collect())) == [(1, 0, 0), (1, 1, 1), (1, 2, 0)]


@pytest.fixture(scope="module")
def random_grids(spark):
    rng = np.random.default_rng(1)
    made = {i: rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.55 for i in range(40)}
    cells = spark.createDataFrame([(i, int(x), int(y)) for i, g in made.items() for y, x in zip(*np.nonzero(g), strict=True)], "grid_id long, x int, y int")
    sizes = spark.createDataFrame([(i, g.shape[1], g.shape[0]) for i, g in made.items()], "grid_id long, cols int, rows int")
    return made, cells, sizes


def _back(df, made, shape=None):
    out = {i: np.zeros(shape or g.shape, bool) for i, g in made.items()}
    for r in df.collect():
        out[r.grid_id][r.y, r.x] = True
    return out


def test_tables_equal_kernels(random_grids):
    made, cells, sizes = random_grids
    for got, f, shape in (
        (grids.dilate(cells, sizes, 3), lambda g: K.dilate(g, 3), None), (grids.erode_soft(cells), K.erode_soft, None),
        (grids.resize(cells, sizes, 12, 11), lambda g: K.resize(g, 12, 11), (11, 12)),
    ):
        back = _back(got, made, shape)
        assert all((back[i] == f(g)).all() for i, g in made.items())
    for side in ("left", "right"):
        got = {r.grid_id: r.has_line for r in grids.vertical_line(cells, sizes, side).collect()}
        assert all(got[i] == K.vertical_line(g, side) for i, g in made.items())
    got = {r.grid_id: r.enclosures for r in grids.enclosures(cells, sizes).collect()}
    assert all(got[i] == K.enclosures(g) for i, g in made.items())
    got = {r.grid_id: r.n_stems for r in grids.stems(cells).collect()}
    assert all(got.get(i, 0) == K.stems(g) for i, g in made.items())
    got = {r.grid_id: r.has_stroke for r in grids.lower_right_stroke(cells).collect()}
    assert all(got.get(i, False) == K.lower_right_stroke(g) for i, g in made.items())


def test_valleys(spark):
    hs = {1: [5, 2, 6, 1, 7], 2: [1, 2, 3], 3: [4, 1, 1, 3, 2, 5]}
    bins = spark.createDataFrame([(k, x, n) for k, h in hs.items() for x, n in enumerate(h)], "k int, x int, n int")
    assert {r.k: r.threshold for r in grids.valley_threshold(bins, "k").collect()} == {k: K.valley_threshold(h) for k, h in hs.items()}


def test_templates(spark, tmp_path):
    m = Row(font="f", rows=1, cols=2, data=["#."])
    base = spark.createDataFrame(
        [(0, "A", 1, False, False, False, False, False, True, False, [m])],
        "def_idx int, character string, enclosures int, lineLeft boolean, lineRight boolean, isAmount boolean, isDate boolean, isDigit boolean, isLetter boolean, "
        "isPunctuation boolean, matrices array<struct<font:string,rows:int,cols:int,data:array<string>>>",
    )
    fresh = spark.createDataFrame([("A", "f", 1, 2, [".#"], 0), ("A", "g", 1, 2, ["##"], 1), ("B", "f", 1, 2, ["#."], 2)], "character string, font string, rows int, cols int, data array<string>, ord int")
    got = {r.character: r for r in P.upsert_templates(base, fresh).collect()}
    assert not got["A"].is_new and got["B"].is_new and [x.font for x in got["A"].matrices] == ["f", "g"] and got["A"].matrices[0].data == [".#"]
    text = P.templates_json(P.upsert_templates(base, fresh).drop("is_new")).first().json
    (tmp_path / "t.json").write_text(text)
    read = P.read_templates(spark, str(tmp_path / "t.json"))
    assert [r.character for r in read.orderBy("def_idx").collect()] == ["A", "B"]
    asked = spark.createDataFrame([("A", 0), ("A", 9), ("Z", 0), ("A", -1)], "character string, index int")
    assert sorted(r.matrix.cols for r in P.get_matrix(read, asked).collect()) == [0, 0, 0, 2]
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="(?i)malformed|json|corrupt"):
        P.read_templates(spark, str(tmp_path / "bad.json")).collect()
    assert len(P.SUPPORTED) == 89  # T21


def test_matching_tables(spark):
    glyphs = spark.createDataFrame([(1, 0, False, True, False)], "g long, enclosures int, is_punctuation boolean, line_left boolean, line_right boolean")
    t = spark.createDataFrame([(0, "P", 1, False, True, False), (1, "R", 1, False, True, False), (2, "x", 2, True, False, True)], "def_idx int, character string, enclosures int, is_punctuation boolean, line_left boolean, line_right boolean")
    assert {r.character for r in matching.qualified(glyphs, t).collect()} == {"P", "R"}
    assert {r.character for r in matching.qualified(glyphs, t, "R").collect()} == {"R"}
    scores = spark.createDataFrame([(1, 0, "P", 0.80), (1, 1, "R", 0.75), (2, 0, "P", 0.90), (2, 1, "R", 0.75), (3, 0, "m", 0.8), (3, 1, "u", 0.1)], "g long, def_idx int, character string, score double")
    ranks = matching.ranked(scores, "g").withColumns({"lower_right": F.lit(True), "aspect": F.lit(2.0), "n_stems": F.col("g")})
    top = {r.g: r.character for r in matching.promoted(ranks.withColumn("n_stems", F.when(F.col("g") == 3, 2).otherwise(9)), "g").where("rank = 1").collect()}
    assert top == {1: "R", 2: "P", 3: "u"}
    assert spark.range(1).select(matching.packed_overlap(F.array(F.lit(6).cast("long")), F.array(F.lit(3).cast("long")))).first()[0] == pytest.approx(1 / 3)


def test_layout_tables(spark):
    gaps = spark.createDataFrame([([],), ([4, 4, 4, 20],), ([3, 3, 3],), ([5],)], "g array<int>")
    assert [r[0] for r in gaps.select(layout.space_threshold(F.col("g"), F.lit(10))).collect()] == [2, 12, 5, 8]
    glyphs = spark.createDataFrame([(1, 0, 0, 0, 5, 9, "a"), (1, 1, 7, 0, 5, 9, "b"), (1, 2, 40, 0, 5, 9, "c")], "k int, pos int, x int, y int, cols int, rows int, character string")
    spaced = layout.insert_spaces(glyphs, ["k"])
    assert layout.band_text(spaced, ["k"]).first().text == "ab c"
    assert [r.ax for r in layout.pack(glyphs, ["k"]).orderBy("pos").collect()] == [0, 9, 18]
    assert layout.total_artifacts(glyphs.withColumn("band", F.col("pos") % 2), "k", "band").first().total == 4


def test_config():
    c = config.BALANCED
    assert (c.dilation_size, c.matching_threshold, c.max_processing_time_ms) == (22, 0.4, 30_000) and config.FAST.dilation_size == 15
    assert c.copy(dilation_size=3) != c and c.copy() == c and hash(c.copy()) == hash(c)
    for bad in ({"dilation_size": 0}, {"matching_threshold": 1.5}, {"max_processing_time_ms": 0}):
        with pytest.raises(ValueError, match="must be"):
            c.copy(**bad)
