"""Queries of recognition: sources and sinks of grids, tests of shapes, templates, ranks, dictionary and evaluation.

Glyphs, pictures and scores are made of the tables' columns, as in queries.py. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import geometry as G
from inkfold.functions import text as T
from inkfold.operators import correction, evaluate, grids, layout, matching
from inkfold.plans.queries import _CELLS, _RECTS, _cells, _rects, _table, query
from inkfold.sources import grids as S
from inkfold.sources import templates

# ------------------------------------------------------------------ sources and sinks

_INK = "coalesce(embedding[y * 8 + x + 1] > 0, false)"
_ROWS = f"WITH p AS (SELECT vec_id, list_transform(range(8), lambda y: array_to_string(list_transform(range(8), lambda x: CASE WHEN {_INK} THEN '#' ELSE '.' END), '')) AS r FROM embeddings)"
_HEX = "replace(replace(array_to_string(r, ''), '#', '01'), '.', '00')"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: F.coalesce(v > 0, F.lit(False))).alias("flat"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("vec_id", S.to_rows(S.pack(F.col("flat"), F.lit(8))).alias("rows"))


def _packed(df: DataFrame, grid: Column) -> DataFrame:
    return df.withColumn("g", grid).select("vec_id", "g.cols", "g.rows", F.hex("g.bits").alias("bits"))


@query(f"{_ROWS} SELECT vec_id, 8 AS cols, 8 AS \"rows\", {_HEX} AS bits FROM p")
def grid_from_ascii(spark, sf_dir):
    return _packed(_pictures(spark, sf_dir), S.from_ascii(F.col("rows")))


@query(f"{_ROWS} SELECT vec_id, 8 AS cols, 8 AS \"rows\", {_HEX} AS bits FROM p")
def grid_from_text(spark, sf_dir):
    return _packed(_pictures(spark, sf_dir), S.from_ascii_text(F.array_join("rows", "\n")))


@query(f"{_ROWS} SELECT vec_id, 7 AS cols, 9 AS \"rows\", substr({_HEX}, 1, 126) AS bits FROM p")
def grid_from_flat(spark, sf_dir):
    """A width that doesn't divide the cells: what is over isn't a row."""
    return _packed(_flat(spark, sf_dir), S.pack(F.col("flat"), F.lit(7)))


@query(f"{_ROWS} SELECT vec_id, 8 AS cols, 8 AS \"rows\", {_HEX} AS bits FROM p")
def grid_from_nested(spark, sf_dir):
    nested = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("flat", y * 8 + 1, F.lit(8)))
    return _packed(_flat(spark, sf_dir), S.from_nested(nested))


@query("""WITH p AS (SELECT l_suppkey, (l_partkey % 97)::INT AS x, l_linenumber AS y FROM lineitem),
b AS (SELECT l_suppkey, min(x) AS l, min(y) AS t, max(x) - min(x) + 1 AS cols, max(y) - min(y) + 1 AS "rows" FROM p GROUP BY 1)
SELECT DISTINCT l_suppkey, x - l AS x, y - t AS y, cols, "rows" FROM p JOIN b USING (l_suppkey)""")
def grid_of_points(spark, sf_dir):
    points = _table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 97).cast("int").alias("x"), F.col("l_linenumber").alias("y"))
    return S.grids_of_points(points, ["l_suppkey"]).select("l_suppkey", "x", "y", "cols", "rows").distinct()


@query(f"{_ROWS} SELECT vec_id, translate(array_to_string(r, chr(10)), '#.', 'X ') AS picture, array_to_string(list_transform(r, lambda s: '\"' || s || '\",'), chr(10)) AS code FROM p")
def grid_to_text(spark, sf_dir):
    g = _flat(spark, sf_dir).withColumn("g", S.pack(F.col("flat"), F.lit(8)))
    return g.select("vec_id", S.to_text(F.col("g"), "X", " ").alias("picture"), S.to_text(F.col("g"), for_code=True).alias("code"))


@query(f"""{_ROWS}, j AS (SELECT vec_id, '"' || array_to_string(r, '","') || '"' AS d FROM p)
SELECT vec_id, '{{"font":"pen","rows":8,"cols":8,"data":[' || d || ']}}' AS matrix, length(d) * 64 + 63 AS repeated FROM j""")
def grid_to_json(spark, sf_dir):
    g = _flat(spark, sf_dir).withColumn("g", S.pack(F.col("flat"), F.lit(8)))
    many = S.to_json(F.col("g"), F.lit("pen"), compat=True)
    head = len('{"font":"pen","rows":8,"cols":8,"data":[') + len("]}")
    return g.select("vec_id", S.to_json(F.col("g"), F.lit("pen")).alias("matrix"), (F.length(many) - head).cast("long").alias("repeated"))


@query(f"{_CELLS} SELECT grid_id, x, y FROM cells")
def grid_cells_of_packed(spark, sf_dir):
    g = _flat(spark, sf_dir).select(F.col("vec_id").alias("grid_id"), S.pack(F.col("flat"), F.lit(8)).alias("grid"))
    return S.cells_of(g)


_PIXELS = """WITH p AS (SELECT l_returnflag AS image_id, l_orderkey AS x, l_linenumber * 100000 + l_partkey AS y, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_quantity::INT AS b FROM lineitem),
v AS (SELECT *, floor(greatest(0, least(255, (floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) - 128) + 128)))::INT AS level FROM p)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("image_id"), F.col("l_orderkey").alias("x"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("y"),
        (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), F.col("l_quantity").cast("int").alias("b"),
    )


@query(f"""{_PIXELS}, c AS (SELECT image_id, level, count(*) AS n FROM v GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER o::DOUBLE AS wb, sum(n * level) OVER o::DOUBLE AS sb, sum(n) OVER a::DOUBLE AS w, sum(n * level) OVER a::DOUBLE AS s FROM c
  WINDOW o AS (PARTITION BY image_id ORDER BY level), a AS (PARTITION BY image_id)),
d AS (SELECT *, wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) AS spread FROM w WHERE w > wb),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY spread DESC, level) AS k FROM d WHERE spread > 0)
SELECT image_id, x, y FROM v LEFT JOIN (SELECT image_id, level AS t FROM k WHERE k = 1) USING (image_id) WHERE level <= coalesce(t, 128)""")
def binarize_pixels(spark, sf_dir):
    return grids.binarize(_pixels(spark, sf_dir))


@query("SELECT l_returnflag AS image_id, l_orderkey AS x, l_linenumber * 100000 + l_partkey AS y FROM lineitem WHERE l_partkey % 256 = 0")
def red_is_zero(spark, sf_dir):
    return S.red_is_zero(_pixels(spark, sf_dir))


# ------------------------------------------------------------------ shapes

_BOX = "box AS (SELECT grid_id, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM s GROUP BY 1)"
_SOME = f"{_CELLS}, s AS (SELECT * FROM cells WHERE grid_id % 3 = 0 OR grid_id % 3 = 1 AND y = 1 OR grid_id % 3 = 2 AND y < 0)"


@query(f"""{_SOME}, {_BOX}, a AS (SELECT vec_id AS grid_id, w, h, coalesce(h / w < 0.09 OR h / w > 50, false) AS line FROM embeddings e LEFT JOIN box ON vec_id = grid_id)
SELECT grid_id, w IS NULL AS is_empty, line AS is_line, line OR 64 <= 2 AS is_speck, coalesce(h < 8 * 0.4, false) AS is_punctuation FROM a""")
def grid_shape_tests(spark, sf_dir):
    """Of all grids; a third have one row of ink left, a third none."""
    cells, sizes = _cells(spark, sf_dir)
    third = F.col("grid_id") % 3
    return grids.shape_tests(cells.where((third == 0) | ((third == 1) & (F.col("y") == 1))), sizes)


@query(f"""{_CELLS}, d AS (SELECT vec_id AS grid_id, (SELECT count(*) FROM cells c WHERE c.grid_id = vec_id) / 64 AS d FROM embeddings)
SELECT grid_id, round(CASE WHEN d <= 0.2 THEN 0.25 WHEN d >= 0.5 THEN 0.45 ELSE 0.25 + 0.2 * ((d - 0.2) / 0.3) END::DOUBLE, 6) AS fill FROM d""")
def grid_fill_threshold(spark, sf_dir):
    cells, sizes = _cells(spark, sf_dir)
    density = sizes.join(grids.count_on(cells), "grid_id", "left").withColumn("d", F.coalesce("n_on", F.lit(0)) / (F.col("cols") * F.col("rows")))
    return density.select("grid_id", F.round(grids.fill_threshold(F.col("d")), 6).alias("fill"))


@query(f"{_CELLS} SELECT grid_id, x - 3 AS x, y + 2 AS y FROM cells")
def grid_translate(spark, sf_dir):
    return grids.translate(_cells(spark, sf_dir)[0], -3, 2)


@query(f"""{_CELLS}, m AS (SELECT vec_id AS grid_id, (vec_id % 10)::INT AS x, (label % 8)::INT AS y, vec_id % 2 = 0 AS on_ FROM embeddings WHERE vec_id % 10 < 8)
SELECT grid_id, x, y FROM (SELECT * FROM cells EXCEPT SELECT grid_id, x, y FROM m) UNION SELECT grid_id, x, y FROM m WHERE on_""")
def grid_set_cells(spark, sf_dir):
    cells, sizes = _cells(spark, sf_dir)
    e = _table(spark, sf_dir, "embeddings")
    marks = e.select(F.col("vec_id").alias("grid_id"), (F.col("vec_id") % 10).cast("int").alias("x"), (F.col("label") % 8).cast("int").alias("y"), (F.col("vec_id") % 2 == 0).alias("on"))
    return grids.set_cells(cells, sizes, marks)


@query(f"""WITH RECURSIVE {_CELLS[5:]},
reach AS (SELECT grid_id, x, y, x AS rx, y AS ry FROM cells
  UNION SELECT r.grid_id, r.x, r.y, c.x, c.y FROM reach r JOIN cells c ON c.grid_id = r.grid_id AND abs(c.x - r.rx) <= 1 AND abs(c.y - r.ry) <= 1),
lab AS (SELECT grid_id, x, y, min(ry::BIGINT * 1048576 + rx) AS label FROM reach GROUP BY 1, 2, 3)
SELECT grid_id, label, min(x) AS "left", min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS n FROM lab GROUP BY 1, 2""")
def grid_component_boxes(spark, sf_dir):
    return grids.component_boxes(grids.components(_cells(spark, sf_dir)[0], True))


@query("""WITH c AS (SELECT event_type, user_id % 40 AS x, count(*) AS c FROM events GROUP BY 1, 2),
h AS (SELECT event_type, x, (SELECT coalesce(max(c * c), 0) FROM c WHERE c.event_type = t.event_type AND c.x = u.x) % 7 AS n FROM (SELECT DISTINCT event_type FROM events) t, range(40) u(x)),
a AS (SELECT *, CASE WHEN n <> lag(n) OVER w THEN 1 ELSE 0 END AS d, lag(n) OVER w AS p, lead(n) OVER w AS q,
  max(n) OVER (PARTITION BY event_type ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS lp, max(n) OVER (PARTITION BY event_type ORDER BY x ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS rp
  FROM h WINDOW w AS (PARTITION BY event_type ORDER BY x)),
b AS (SELECT *, sum(d) OVER (PARTITION BY event_type ORDER BY x) AS run FROM a),
r AS (SELECT event_type, run, min(x) AS f, max(x) AS l, min(n) AS v, arg_min(p, x) FILTER (p IS NOT NULL OR x = 0) AS p, arg_max(coalesce(q, -1), x) AS q, arg_min(coalesce(lp, -1), x) AS lp, arg_max(coalesce(rp, -1), x) AS rp FROM b GROUP BY 1, 2)
SELECT event_type, (f + (l - f) // 2)::INT AS valley FROM r WHERE f > 0 AND l < 39 AND v <= p AND (l > f OR v <= q) AND least(lp, rp) > 0 AND v <= floor(least(lp, rp) * 0.4 + 0.5)""")
def soft_valleys(spark, sf_dir):
    """Of a rough profile of the events of each kind."""
    events = _table(spark, sf_dir, "events")
    found = events.groupBy("event_type", (F.col("user_id") % 40).alias("x")).agg(F.count("*").alias("c"))
    every = events.select("event_type").distinct().withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    bins = every.join(found, ["event_type", "x"], "left").withColumn("n", F.coalesce(F.col("c") * F.col("c"), F.lit(0)) % 7)
    return grids.soft_valleys(bins, "event_type")


# ------------------------------------------------------------------ rectangles


@query(f"""{_RECTS} SELECT l_orderkey, id, x + 5 AS moved_left, y - 3 AS moved_top, x + id AS shifted, x + w // 2 - 4 // 2 AS around, (x + id) AS sum_x, (x - y) AS difference, y * 3 AS product,
  trunc(x / id)::INT AS quotient, '(' || x || ', ' || y || ')' AS told FROM r""")
def offset_algebra(spark, sf_dir):
    r, i = F.col("rect"), F.col("id")
    o = G.point(r, "left", "top")
    moved = G.translate(r, F.lit(5), F.lit(-3))
    return _rects(spark, sf_dir).select(
        "l_orderkey", "id", moved["left"].alias("moved_left"), moved["top"].alias("moved_top"), G.shift(r, G.offset(i, i))["left"].alias("shifted"),
        G.rect_center(G.point(r, "center", "center"), F.lit(4), F.lit(4))["left"].alias("around"), G.add(o, G.offset(i, i))["x"].alias("sum_x"),
        G.subtract(o, G.offset(o["y"], o["x"]))["x"].alias("difference"), G.multiply(o, F.lit(3))["y"].alias("product"), G.divide(o, i)["x"].alias("quotient"),
        G.offset_string(o).alias("told"),
    )


@query(f"""{_RECTS}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(w) OVER w AS nw, lead(h) OVER w AS nh FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY id))
SELECT l_orderkey, id, (y <= ny + nh AND y + h >= ny) AS touches_v, (x < nx + nw AND x + w > nx) AS touches_h, (nx - x - w > 0 AND nx - x - w <= ((nh + h) // 2) * 1.2::DOUBLE) AS joins FROM n WHERE nx IS NOT NULL""")
def rect_relations(spark, sf_dir):
    from pyspark.sql.window import Window

    r = _rects(spark, sf_dir).withColumn("next", F.lead("rect").over(Window.partitionBy("l_orderkey").orderBy("id"))).where("next is not null")
    a, b = F.col("rect"), F.col("next")
    return r.select("l_orderkey", "id", G.intersects_vertically(a, b).alias("touches_v"), G.intersects_horizontally(a, b).alias("touches_h"), G.should_join_lines(a, b).alias("joins"))


@query(f"""{_RECTS} SELECT l_orderkey, min(x) AS "left", min(y) AS top, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height FROM r GROUP BY 1""")
def bounding_boxes(spark, sf_dir):
    return _rects(spark, sf_dir).groupBy("l_orderkey").agg(G.bounding_box(F.col("rect")).alias("b")).select("l_orderkey", "b.left", "b.top", "b.width", "b.height")


# ------------------------------------------------------------------ templates and ranks

_FEATURES = """WITH g AS (SELECT p_partkey, p_size % 3 AS e, p_partkey % 5 = 0 AS p, p_size % 2 = 0 AS l, floor(p_retailprice)::INT % 2 = 0 AS r FROM part),
t AS (SELECT n_nationkey AS def_idx, n_name AS character, n_nationkey % 3 AS te, n_nationkey % 7 = 0 AS tp, n_regionkey % 2 = 0 AS tl, n_nationkey % 2 = 0 AS tr FROM nation)"""


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, nation = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "nation")
    glyphs = part.select(
        "p_partkey", (F.col("p_size") % 3).alias("enclosures"), (F.col("p_partkey") % 5 == 0).alias("is_punctuation"), (F.col("p_size") % 2 == 0).alias("line_left"),
        (F.floor("p_retailprice").cast("int") % 2 == 0).alias("line_right"),
    )
    key = F.col("n_nationkey")
    return glyphs, nation.select(
        key.alias("def_idx"), F.col("n_name").alias("character"), (key % 3).alias("enclosures"), (key % 7 == 0).alias("is_punctuation"), (F.col("n_regionkey") % 2 == 0).alias("line_left"), (key % 2 == 0).alias("line_right"),
    )


@query(f"{_FEATURES} SELECT p_partkey, def_idx, character FROM g, t WHERE (e = te)::INT + (p = tp)::INT + (l = tl)::INT + (r = tr)::INT >= 2")
def template_prefilter(spark, sf_dir):
    glyphs, known = _features(spark, sf_dir)
    return matching.qualified(glyphs, known).select("p_partkey", "def_idx", "character")


@query(f"""{_CELLS}, t AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS tid FROM embeddings),
n AS (SELECT vec_id, (SELECT count(*) FROM cells c WHERE c.grid_id = vec_id) AS n FROM embeddings),
b AS (SELECT t.vec_id, count(*) AS c FROM t JOIN cells x ON x.grid_id = t.vec_id JOIN cells y ON y.grid_id = t.tid AND x.x = y.x AND x.y = y.y GROUP BY 1)
SELECT t.vec_id, round(coalesce(coalesce(c, 0) / nullif(a.n + d.n - coalesce(c, 0), 0), 0)::DOUBLE, 6) AS score FROM t LEFT JOIN b USING (vec_id) JOIN n a ON a.vec_id = t.vec_id JOIN n d ON d.vec_id = t.tid""")
def template_overlap(spark, sf_dir):
    """Each grid with the first one of its label."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", matching.pack_bits(F.transform("embedding", lambda v: F.coalesce(v > 0, F.lit(False)))).alias("bits"))
    first = e.groupBy("label").agg(F.min_by("bits", "vec_id").alias("t"))
    return e.join(first, "label").select("vec_id", F.round(matching.packed_overlap(F.col("bits"), F.col("t")), 6).alias("score"))


_SCORES = """WITH s AS (SELECT l_suppkey, (l_partkey % 12)::INT AS def_idx, chr(65 + (l_partkey % 12)::INT) AS character, (l_orderkey % 4)::INT AS matrix_index, l_quantity / 64 AS iou FROM lineitem),
b AS (SELECT l_suppkey, def_idx, character, max(iou) * 0.7 + avg(iou) * 0.3 AS score, arg_max(matrix_index, struct_pack(a := iou, b := -matrix_index)) AS matrix_index FROM s GROUP BY 1, 2, 3)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = _table(spark, sf_dir, "lineitem"), (F.col("l_partkey") % 12).cast("int")
    rows = li.select("l_suppkey", part.alias("def_idx"), F.char(part + 65).alias("character"), (F.col("l_orderkey") % 4).cast("int").alias("matrix_index"), (F.col("l_quantity") / 64).alias("iou"))
    return matching.combine(rows, "l_suppkey")


@query(f"{_SCORES} SELECT l_suppkey, def_idx, character, matrix_index, round(score, 9) AS score FROM b")
def template_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 9)).select("l_suppkey", "def_idx", "character", "matrix_index", "score")


@query(f"""{_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(score, 9) DESC, def_idx) AS rank FROM b)
SELECT l_suppkey, character, rank::INT AS rank FROM r WHERE rank <= 3""")
def template_ranks(spark, sf_dir):
    scores = _scores(spark, sf_dir).withColumn("score", F.round("score", 9))
    return matching.ranked(scores, "l_suppkey", top=3).select("l_suppkey", "character", "rank")


def _raise_sql(source: str, heads: str, others: str, allowed: str) -> str:
    return f"""SELECT * REPLACE (CASE WHEN contains('{heads}', hc) AND orank IS NOT NULL AND {allowed} THEN CASE WHEN rank = orank THEN 1 WHEN rank < orank THEN rank + 1 ELSE rank END ELSE rank END AS rank)
  FROM (SELECT * EXCLUDE (hc, hs, orank, oscore), max(CASE WHEN rank = 1 THEN character END) OVER w AS hc, max(CASE WHEN rank = 1 THEN score END) OVER w AS hs,
    min(CASE WHEN contains('{others}', character) THEN rank END) OVER w AS orank,
    arg_min(score, rank) FILTER (contains('{others}', character)) OVER w AS oscore FROM {source} WINDOW w AS (PARTITION BY o_custkey))"""


@query(f"""WITH s AS (SELECT o_custkey, substr('PRpmuxyz', (o_orderkey % 8)::INT + 1, 1) AS character, (o_orderkey % 8)::INT AS def_idx, max(o_totalprice) / 4000000 AS score,
  o_custkey % 2 = 0 AS lower_right, (o_custkey % 4)::BIGINT AS n_stems, 0.8 + (o_custkey % 5) / 10.0 AS aspect FROM orders GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, def_idx) AS rank, '' AS hc, 0.0 AS hs, 0 AS orank, 0.0 AS oscore FROM s),
a AS ({_raise_sql("k", "Pp", "Rr", "lower_right AND hs - oscore <= 0.06")}),
b AS ({_raise_sql("a", "m", "u", "(n_stems <= 2 OR aspect < 1.05 AND hs - oscore <= 0.08)")})
SELECT o_custkey, character, rank::INT AS rank FROM b""")
def template_promotions(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    kind = (F.col("o_orderkey") % 8).cast("int")
    key = F.col("o_custkey")
    scores = orders.groupBy(key, kind.alias("def_idx")).agg((F.max("o_totalprice") / 4000000).alias("score")).withColumns({
        "character": F.substring(F.lit("PRpmuxyz"), F.col("def_idx") + 1, F.lit(1)), "lower_right": key % 2 == 0, "n_stems": (key % 4).cast("long"),
        "aspect": F.lit(0.8) + (key % 5) / F.lit(10.0),
    })
    return matching.promoted(matching.ranked(scores, "o_custkey"), "o_custkey").select("o_custkey", "character", "rank")


_KNOWN = """WITH t AS (SELECT n_nationkey AS def_idx, n_name AS character, n_regionkey AS k FROM nation)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each nation, with as many matrices of one cell as its region's number."""
    one = lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("font"), F.lit(1).alias("rows"), F.lit(1).alias("cols"), F.array(F.lit("#")).alias("data"))
    some = F.when(F.col("n_regionkey") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_regionkey", F.lit(1))), one)).otherwise(F.array().cast("array<struct<font:string,rows:int,cols:int,data:array<string>>>"))
    return _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("def_idx"), F.col("n_name").alias("character"), F.lit(0).alias("enclosures"), F.lit(False).alias("line_left"), F.lit(False).alias("line_right"),
        F.lit(False).alias("is_punctuation"), some.alias("matrices"),
    )


@query(f"""{_KNOWN} SELECT c_custkey, CASE WHEN c_custkey % 4 < k THEN 'f' || (c_custkey % 4 + 1) END AS font, CASE WHEN c_custkey % 4 < k THEN 1 ELSE 0 END AS "rows"
  FROM customer LEFT JOIN t ON character = 'NATION_' || c_nationkey""")
def template_matrix(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("character"), (F.col("c_custkey") % 4).cast("int").alias("index"))
    return templates.get_matrix(_known(spark, sf_dir), asked).select("c_custkey", "matrix.font", "matrix.rows")


@query(f"""{_KNOWN}, f AS (SELECT DISTINCT 'NATION_' || (s_nationkey * 2) AS character, 'f' || (s_suppkey % 6) AS font FROM supplier),
u AS (SELECT character, 'f' || i AS font FROM t, range(1, 9) r(i) WHERE i <= k UNION SELECT character, font FROM f)
SELECT character, count(font)::INT AS n_fonts, (SELECT count(*) FROM t WHERE t.character = a.character) = 0 AS is_new FROM (SELECT character, font FROM u UNION ALL SELECT character, NULL FROM t) a GROUP BY 1""")
def template_upsert(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    fresh = s.select(
        F.concat(F.lit("NATION_"), (F.col("s_nationkey") * 2).cast("string")).alias("character"), F.concat(F.lit("f"), (F.col("s_suppkey") % 6).cast("string")).alias("font"),
        F.lit(2).alias("rows"), F.lit(1).alias("cols"), F.array(F.lit("#"), F.lit(".")).alias("data"), F.col("s_suppkey").cast("int").alias("ord"),
    )
    return templates.upsert_templates(_known(spark, sf_dir), fresh).select("character", F.size("matrices").alias("n_fonts"), "is_new")


# ------------------------------------------------------------------ words

_TRIED = [(k, s) for k, subs in correction.CONFUSIONS for s in subs]
_GUESSES = "list_filter([" + ", ".join(f"CASE WHEN contains(w, '{k}') THEN replace(w, '{k}', '{s}') END" for k, s in _TRIED) + "], lambda x: x IS NOT NULL)"
_WORDS = "SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM conversations"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("w")).distinct()


@query(f"WITH w AS ({_WORDS}) SELECT w, array_to_string({_GUESSES}, '|') AS guesses FROM w")
def word_confusions(spark, sf_dir):
    return _words(spark, sf_dir).select("w", F.array_join(correction.confusions(F.col("w")), "|").alias("guesses"))


_SUGGESTED = "lower(reverse(w))"


@query(f"""WITH w AS ({_WORDS}), s AS (SELECT w, {_SUGGESTED} AS g FROM w), p AS (SELECT w, g || CASE WHEN right(w, 1) = 's' OR right(w, 1) = 'S' AND length(w) - 1 = length(g) THEN right(w, 1) ELSE '' END AS g FROM s)
SELECT w, CASE WHEN length(w) = length(g) THEN array_to_string([CASE WHEN lower(w[i]) = lower(g[i]) THEN w[i] ELSE g[i] END FOR i IN range(1, length(w) + 1)], '') ELSE g END AS cased FROM p""")
def word_casing(spark, sf_dir):
    return _words(spark, sf_dir).select("w", correction.with_casing(F.col("w"), F.lower(F.reverse("w"))).alias("cased"))


# ------------------------------------------------------------------ evaluation

_PAIRS = "SELECT item_id, text AS e, replace(substr(text, 1, (length(text) * 3) // 4), 'e', 'c') AS f FROM benchmark"


@query(f"""WITH p AS ({_PAIRS}), i AS (SELECT item_id, e, f, unnest(range(greatest(length(e), length(f)))) AS pos FROM p)
SELECT item_id, pos::INT AS pos, CASE WHEN pos < length(f) THEN f[pos + 1] ELSE ' ' END AS found, CASE WHEN pos < length(e) THEN e[pos + 1] ELSE '!' END AS expected,
  CASE WHEN pos < length(f) THEN f[pos + 1] ELSE ' ' END = CASE WHEN pos < length(e) THEN e[pos + 1] ELSE '!' END AS same FROM i""")
def aligned_characters(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    cut = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") * 3 / 4).cast("int"))
    return evaluate.aligned(b.select("item_id", F.replace(cut, F.lit("e"), F.lit("c")).alias("text")), b.select("item_id", "text"), "item_id")


@query(f"""{_CELLS}, q AS (SELECT vec_id AS grid_id, r::INT AS rect_id, (r * 3)::INT AS l, 1 AS t, 4 AS w, 5 AS h FROM embeddings, range(2) u(r))
SELECT q.grid_id, rect_id, a::INT AS x, (SELECT count(*) FROM cells c WHERE c.grid_id = q.grid_id AND c.x = l + a AND c.y >= t AND c.y < t + h) AS n FROM q, range(4) v(a)""")
def region_profiles(spark, sf_dir):
    cells, sizes = _cells(spark, sf_dir)
    one = lambda r: F.struct(F.lit(r).alias("rect_id"), F.lit(3 * r).alias("left"), F.lit(1).alias("top"), F.lit(4).alias("width"), F.lit(5).alias("height"))
    return evaluate.region_profiles(cells, sizes.select("grid_id", F.inline(F.array(one(0), one(1)))))
