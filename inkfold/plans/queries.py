"""The queries of the library's own operators, each with the same in SQL where SQL can say it.

An embedding of 64 numbers is an 8 x 8 grid with ink where it is above 0; a line of an order is a rectangle or a
glyph. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkfold.functions import geometry as G
from inkfold.functions import text as T
from inkfold.operators import correction, evaluate, grids, layout, matching

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "grid_id")
    on = e.select("grid_id", F.posexplode("embedding").alias("i", "v")).where("v > 0")
    cells = on.select("grid_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"))
    return cells, e.select("grid_id", F.lit(8).alias("cols"), F.lit(8).alias("rows"))


_CELLS = """WITH cells AS (SELECT vec_id AS grid_id, (i % 8)::INT AS x, (i // 8)::INT AS y
  FROM embeddings, range(64) t(i) WHERE embedding[i + 1] > 0)"""

# ------------------------------------------------------------------ grids


@query(f"{_CELLS} SELECT grid_id, x, y FROM cells")
def grid_cells(spark, sf_dir):
    return _cells(spark, sf_dir)[0]


@query(f"{_CELLS} SELECT vec_id AS grid_id, a::INT AS x, (SELECT count(*) FROM cells c WHERE c.grid_id = vec_id AND c.x = a) AS n FROM embeddings, range(8) t(a)")
def grid_profile_cols(spark, sf_dir):
    return grids.profile(*_cells(spark, sf_dir), "x")


@query(f"{_CELLS} SELECT vec_id AS grid_id, a::INT AS y, (SELECT count(*) FROM cells c WHERE c.grid_id = vec_id AND c.y = a) AS n FROM embeddings, range(8) t(a)")
def grid_profile_rows(spark, sf_dir):
    return grids.profile(*_cells(spark, sf_dir), "y")


@query(f'{_CELLS} SELECT grid_id, min(x) AS "left", min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM cells GROUP BY grid_id')
def grid_content_rect(spark, sf_dir):
    return grids.content_rect(_cells(spark, sf_dir)[0])


@query(f"{_CELLS} SELECT grid_id, count(*) AS n_on FROM cells GROUP BY grid_id")
def grid_count_on(spark, sf_dir):
    return grids.count_on(_cells(spark, sf_dir)[0])


@query(f"""{_CELLS} SELECT DISTINCT grid_id, (x + dx)::INT AS x, (y + dy)::INT AS y FROM cells, range(-1, 2) a(dx), range(-1, 2) b(dy)
  WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7""")
def grid_dilate(spark, sf_dir):
    return grids.dilate(*_cells(spark, sf_dir), 3)


@query(f"""{_CELLS} SELECT a.grid_id, a.x, a.y FROM cells a JOIN cells b ON a.grid_id = b.grid_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
  GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def grid_erode_soft(spark, sf_dir):
    return grids.erode_soft(_cells(spark, sf_dir)[0])


@query(f"""{_CELLS} SELECT grid_id, a::INT AS x, b::INT AS y FROM cells, range(12) t(a), range(12) u(b)
  WHERE x = floor(a * (8 / 12.0)) AND y = floor(b * (8 / 12.0))""")
def grid_resize_nearest(spark, sf_dir):
    return grids.resize(*_cells(spark, sf_dir), 12, 12)


@query(f"""{_CELLS} SELECT grid_id, a::INT AS x, b::INT AS y FROM cells, range(3) t(a), range(3) u(b)
  WHERE x >= floor(a * 8 / 3.0) AND x < least(8, ceil(a * 8 / 3.0 + 8 / 3.0)) AND y >= floor(b * 8 / 3.0) AND y < least(8, ceil(b * 8 / 3.0 + 8 / 3.0))
  GROUP BY grid_id, a, b HAVING count(*) / ((least(8, ceil(a * 8 / 3.0 + 8 / 3.0)) - floor(a * 8 / 3.0)) * (least(8, ceil(b * 8 / 3.0 + 8 / 3.0)) - floor(b * 8 / 3.0))) >= 0.3""")
def grid_resize_box(spark, sf_dir):
    return grids.resize(*_cells(spark, sf_dir), 3, 3)


def _line_sql(step: int) -> str:
    return f"""{_CELLS},
free AS (SELECT * FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.grid_id = a.grid_id AND b.x = a.x + ({step}) AND b.y = a.y)),
runs AS (SELECT grid_id, x, g, count(*) AS run FROM (SELECT grid_id, x, y - row_number() OVER (PARTITION BY grid_id, x ORDER BY y) AS g FROM free) GROUP BY 1, 2, 3)
SELECT vec_id AS grid_id, coalesce((SELECT max(run) FROM runs WHERE runs.grid_id = vec_id), 0) >= 5 AS has_line FROM embeddings"""


@query(_line_sql(-1))
def grid_vertical_line_left(spark, sf_dir):
    return grids.vertical_line(*_cells(spark, sf_dir), "left")


@query(_line_sql(1))
def grid_vertical_line_right(spark, sf_dir):
    return grids.vertical_line(*_cells(spark, sf_dir), "right")


@query(f"""{_CELLS}, col AS (SELECT grid_id, x, count(*) AS n FROM cells GROUP BY 1, 2),
tall AS (SELECT grid_id, x FROM (SELECT *, greatest(1, round(max(n) OVER (PARTITION BY grid_id) * 0.8)) AS lim FROM col) WHERE n >= lim),
starts AS (SELECT grid_id, x - lag(x) OVER (PARTITION BY grid_id ORDER BY x) AS d FROM tall)
SELECT grid_id, sum(CASE WHEN d IS NULL OR d > 1 THEN 1 ELSE 0 END)::BIGINT AS n_stems FROM starts GROUP BY grid_id""")
def grid_vertical_stems(spark, sf_dir):
    return grids.stems(_cells(spark, sf_dir)[0])


@query(f"""{_CELLS}, box AS (SELECT grid_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM cells GROUP BY 1),
cut AS (SELECT *, l + round((r - l) * 0.55) AS x0, t + round((b - t) * 0.55) AS y0 FROM box),
ink AS (SELECT grid_id, (r - x0) * (b - y0) AS part, (r - l) * (b - t) AS whole, count(*) AS n, count(*) FILTER (x >= x0 AND y >= y0) AS m
  FROM cells JOIN cut USING (grid_id) GROUP BY 1, 2, 3)
SELECT grid_id, coalesce(part > 0 AND m / nullif(part, 0) >= n / whole * 0.6, false) AS has_stroke FROM ink""")
def grid_lower_right_stroke(spark, sf_dir):
    return grids.lower_right_stroke(_cells(spark, sf_dir)[0])


@query(f"""WITH RECURSIVE {_CELLS[5:]},
reach AS (SELECT grid_id, x, y, x AS rx, y AS ry FROM cells
  UNION SELECT r.grid_id, r.x, r.y, c.x, c.y FROM reach r JOIN cells c ON c.grid_id = r.grid_id AND abs(c.x - r.rx) <= 1 AND abs(c.y - r.ry) <= 1)
SELECT grid_id, x, y, min(ry::BIGINT * 1048576 + rx) AS label FROM reach GROUP BY 1, 2, 3""")
def grid_components(spark, sf_dir):
    return grids.components(_cells(spark, sf_dir)[0], True)


@query(f"""WITH RECURSIVE {_CELLS[5:]},
back AS (SELECT vec_id AS grid_id, (i % 8)::INT AS x, (i // 8)::INT AS y FROM embeddings, range(64) t(i) WHERE NOT coalesce(embedding[i + 1] > 0, false)),
reach AS (SELECT grid_id, x, y, x AS rx, y AS ry FROM back
  UNION SELECT r.grid_id, r.x, r.y, c.x, c.y FROM reach r JOIN back c ON c.grid_id = r.grid_id AND abs(c.x - r.rx) + abs(c.y - r.ry) = 1),
lab AS (SELECT grid_id, x, y, min(ry * 8 + rx) AS label FROM reach GROUP BY 1, 2, 3),
holes AS (SELECT grid_id, label FROM lab GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (x IN (0, 7) OR y IN (0, 7)) = 0)
SELECT vec_id AS grid_id, (SELECT count(*) FROM holes h WHERE h.grid_id = vec_id) AS enclosures FROM embeddings""")
def grid_enclosures(spark, sf_dir):
    return grids.enclosures(*_cells(spark, sf_dir))


@query(f"{_CELLS}, box AS (SELECT grid_id, min(x) AS l, min(y) AS t FROM cells GROUP BY 1) SELECT grid_id, x - l AS x, y - t AS y FROM cells JOIN box USING (grid_id)")
def grid_trim(spark, sf_dir):
    return grids.trim(_cells(spark, sf_dir)[0])[0]


@query(f"{_CELLS} SELECT grid_id, x + 1 AS x, y + 3 AS y FROM cells")
def grid_wrap_and_pad(spark, sf_dir):
    cells, sizes = grids.wrap(*_cells(spark, sf_dir))
    return grids.pad(cells, sizes, 2, 1)[0]


@query(f"{_CELLS} SELECT grid_id, 0 AS rect_id, x - 2 AS x, y - 1 AS y FROM cells WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def grid_crop(spark, sf_dir):
    cells, sizes = _cells(spark, sf_dir)
    rects = sizes.select("grid_id", F.lit(0).alias("rect_id"), F.lit(2).alias("left"), F.lit(1).alias("top"), F.lit(5).alias("width"), F.lit(4).alias("height"))
    return grids.crop(cells, rects)


@query(f"{_CELLS} SELECT grid_id, x, y FROM cells UNION SELECT grid_id, x + 2, y + 1 FROM cells")
def grid_paste(spark, sf_dir):
    cells, _ = _cells(spark, sf_dir)
    return grids.paste(cells, cells, 2, 1)


@query(f"{_CELLS} SELECT DISTINCT grid_id, x, y FROM (SELECT grid_id, x + 3 AS x, y AS y FROM cells UNION ALL SELECT grid_id, x, y + 2 FROM cells)")
def grid_merge(spark, sf_dir):
    cells, _ = _cells(spark, sf_dir)
    a = cells.withColumns({"at_x": F.lit(5), "at_y": F.lit(1)})
    return grids.merge(a, cells.withColumns({"at_x": F.lit(2), "at_y": F.lit(3)}))


@query(f"{_CELLS} SELECT grid_id, x // 3 AS part, x % 3 AS x, y FROM cells")
def grid_split_columns(spark, sf_dir):
    cells, sizes = _cells(spark, sf_dir)
    return grids.split_columns(cells, sizes.select("grid_id", F.array(F.lit(3), F.lit(6)).alias("offsets")))


@query(f"""{_CELLS}, first AS (SELECT label AS template_id, min(vec_id) AS grid_id FROM embeddings GROUP BY 1),
t AS (SELECT template_id, x, y FROM cells JOIN first USING (grid_id)),
m AS (SELECT template_id, count(*) AS m FROM t GROUP BY 1), n AS (SELECT grid_id, count(*) AS n FROM cells GROUP BY 1),
b AS (SELECT grid_id, template_id, count(*) AS c FROM cells JOIN t USING (x, y) GROUP BY 1, 2),
r AS (SELECT grid_id, template_id, c, n + m - c AS e, row_number() OVER (PARTITION BY grid_id ORDER BY c / (n + m - c) DESC, template_id) AS k
  FROM b JOIN n USING (grid_id) JOIN m USING (template_id))
SELECT grid_id, template_id, c AS "both", e AS either FROM r WHERE k = 1""")
def template_iou_top1(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "label", matching.pack_bits(F.transform("embedding", lambda v: F.coalesce(v > 0, F.lit(False)))).alias("bits"))
    templates = e.groupBy(F.col("label").alias("template_id")).agg(F.min_by("bits", "vec_id").alias("bits"))
    best = matching.best_template(F.col("bits"), templates)
    found = e.select(F.col("vec_id").alias("grid_id"), best.alias("b")).where("b is not null")
    return found.select("grid_id", F.col("b.template_id").cast("int").alias("template_id"), F.col("b.both").cast("long").alias("both"), F.col("b.either").cast("long").alias("either"))


@query("""WITH c AS (SELECT l_returnflag, (l_quantity * 5)::INT AS level, count(*) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER o::DOUBLE AS wb, sum(n * level) OVER o::DOUBLE AS sb, sum(n) OVER a::DOUBLE AS w, sum(n * level) OVER a::DOUBLE AS s FROM c
  WINDOW o AS (PARTITION BY l_returnflag ORDER BY level), a AS (PARTITION BY l_returnflag)),
d AS (SELECT *, wb * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) AS v FROM w WHERE w > wb),
k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, level) AS k FROM d WHERE v > 0)
SELECT l_returnflag, level AS threshold FROM k WHERE k = 1""")
def otsu_threshold(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 5).cast("int").alias("level"))
    return grids.otsu_thresholds(li, "l_returnflag", "level")


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_quantity::INT AS b FROM lineitem)
SELECT id, line, floor(greatest(0, least(255, (259 * (30 + 255) / (255.0::DOUBLE * (259 - 30))) * (floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) - 128) + 128)))::INT AS gray FROM p""")
def gray_contrast(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    gray = grids.luma(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_quantity").cast("int"), 30.0)
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), gray.alias("gray"))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS x, count(*) AS n FROM events GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN n <> lag(n) OVER (PARTITION BY event_type ORDER BY x) THEN 1 ELSE 0 END AS d FROM h),
b AS (SELECT *, sum(d) OVER (PARTITION BY event_type ORDER BY x) AS run FROM a),
c AS (SELECT event_type, run, min(n) AS v FROM b GROUP BY 1, 2),
e AS (SELECT event_type, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM c WINDOW w AS (PARTITION BY event_type ORDER BY run))
SELECT event_type, coalesce(floor(min(v) FILTER (v < p AND v < q) * 1.2), -1)::BIGINT AS threshold FROM e GROUP BY 1""")
def valley_threshold(spark, sf_dir):
    bins = _table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("x")).agg(F.count("*").alias("n"))
    return grids.valley_threshold(bins, "event_type")


# ------------------------------------------------------------------ rectangles and layout


def _place() -> Column:
    """A line's place in its order; line numbers may repeat."""
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


_PLACE = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INT"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    r = G.rect(F.col("l_partkey") % 40, F.col("l_suppkey") % 30, F.col("l_quantity"), F.col("l_linenumber") * 5)
    return li.select("l_orderkey", _place().alias("id"), r.alias("rect"))


_RECTS = f"""WITH r AS (SELECT l_orderkey, {_PLACE} AS id, (l_partkey % 40)::INT AS x, (l_suppkey % 30)::INT AS y, l_quantity::INT AS w, (l_linenumber * 5)::INT AS h FROM lineitem)"""


@query(f"""{_RECTS} SELECT l_orderkey, id, x + w AS r, y + h AS b, x + w // 2 AS cx, y + h // 2 AS cy, (w = 0 AND h = 0) AS empty,
  (20 >= x AND 20 < x + w AND 15 >= y AND 15 < y + h) AS has_point, (10 >= x AND 20 <= x + w AND 10 >= y AND 20 <= y + h) AS has_rect,
  least(x, 10) AS ux, greatest(y + h, 20) - least(y, 10) AS uh,
  CASE WHEN greatest(x, 10) < least(x + w, 20) AND greatest(y, 10) < least(y + h, 20) THEN least(x + w, 20) - greatest(x, 10) ELSE 0 END AS iw,
  greatest(0, 10 - x - w, x - 20, 10 - y - h, y - 20) AS far FROM r""")
def rect_algebra(spark, sf_dir):
    r, q = F.col("rect"), G.rect(F.lit(10), F.lit(10), F.lit(10), F.lit(10))
    c = G.point(r, "center", "center")
    return _rects(spark, sf_dir).select(
        "l_orderkey", "id", G.right(r).alias("r"), G.bottom(r).alias("b"), c["x"].alias("cx"), c["y"].alias("cy"), G.is_empty(r).alias("empty"),
        G.contains_xy(r, F.lit(20), F.lit(15)).alias("has_point"), G.contains_rect(r, q).alias("has_rect"), G.union_box(r, q)["left"].alias("ux"),
        G.union_box(r, q)["height"].alias("uh"), G.intersection(r, q)["width"].alias("iw"), G.rect_distance(r, q).alias("far"),
    )


@query(f"""{_RECTS}, p AS (SELECT a.l_orderkey, a.id AS a_id, b.id AS b_id, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw,
  least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih, least(a.w * a.h, b.w * b.h) AS area FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.id < b.id)
SELECT l_orderkey, a_id, b_id FROM p WHERE iw > 0 AND ih > 0 AND iw * ih >= area * 0.8::DOUBLE""")
def rect_overlap_join(spark, sf_dir):
    return layout.overlapping_rects(_rects(spark, sf_dir), "l_orderkey")


@query(f"""{_RECTS}, p AS (SELECT s.l_orderkey, s.id AS small_id, b.id AS large_id,
  greatest(0, b.x - s.x - s.w, s.x - b.x - b.w, b.y - s.y - s.h, s.y - b.y - b.h) AS d
  FROM r s JOIN r b ON s.l_orderkey = b.l_orderkey WHERE s.w <= 10 AND b.w > 10
  AND s.x >= b.x - 6 AND s.x + s.w <= b.x + b.w + 6 AND s.y >= b.y - 6 AND s.y + s.h <= b.y + b.h + 6)
SELECT l_orderkey, small_id, large_id, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, small_id ORDER BY d, large_id) AS k FROM p) WHERE k = 1""")
def rect_nearest(spark, sf_dir):
    r = _rects(spark, sf_dir)
    small = r.where("rect.width <= 10").select("l_orderkey", F.col("id").alias("small_id"), F.col("rect").alias("small"))
    large = r.where("rect.width > 10").select("l_orderkey", F.col("id").alias("large_id"), F.col("rect").alias("large"))
    return layout.nearest_rects(small, large, "l_orderkey", 6)


@query(f"""{_RECTS}, k AS (SELECT *, lag(y) OVER w AS py, lag(h) OVER w AS ph FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY id)),
f AS (SELECT *, CASE WHEN py <= y + h AND py + ph >= y AND abs((py + ph // 2) - (y + h // 2)) < ((ph + h) // 2) * 0.4::DOUBLE THEN 0 ELSE 1 END AS n FROM k)
SELECT l_orderkey, id, (sum(n) OVER (PARTITION BY l_orderkey ORDER BY id) - 1)::BIGINT AS row_id FROM f""")
def row_islands(spark, sf_dir):
    return layout.row_islands(_rects(spark, sf_dir), "l_orderkey", "id").select("l_orderkey", "id", "row_id")


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order in a row: as wide as the quantity, with gaps that depend on the part."""
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", _place().alias("pos"), "l_partkey", F.col("l_quantity").cast("int").alias("cols"))
    before = Window.partitionBy("l_orderkey").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = F.coalesce(F.sum(F.col("cols") + F.col("l_partkey") % 17).over(before), F.lit(0))
    return li.select("l_orderkey", "pos", x.cast("int").alias("x"), F.lit(3).alias("y"), "cols", F.lit(12).alias("rows"), F.lit("x").alias("character"))


_GLYPHS = f"""WITH n AS (SELECT l_orderkey, {_PLACE} AS pos, l_partkey, l_quantity::INT AS cols FROM lineitem),
g AS (SELECT l_orderkey, pos, cols, coalesce(sum(cols + l_partkey % 17) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS x FROM n),
gaps AS (SELECT *, x - lag(x + cols) OVER (PARTITION BY l_orderkey ORDER BY pos) AS gap FROM g),
stats AS (SELECT l_orderkey, count(*) AS n,
  (CASE WHEN count(*) < 2 THEN max(x + cols) - min(x) ELSE round(sum(cols) FILTER (gap IS NOT NULL) / count(*)) END)::INT AS average_width,
  (CASE WHEN count(*) < 2 THEN -1 ELSE round(sum(gap) / count(*)) END)::INT AS average_kerning FROM gaps GROUP BY 1)"""


@query(f"{_GLYPHS} SELECT * FROM stats")
def band_stats(spark, sf_dir):
    return layout.band_stats(_glyphs(spark, sf_dir), ["l_orderkey"])


@query(f"""{_GLYPHS} SELECT l_orderkey, pos, (min(x) OVER (PARTITION BY l_orderkey) +
  coalesce(sum(cols + 4) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS ax FROM g""")
def pack_running_sum(spark, sf_dir):
    return layout.pack(_glyphs(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "pos", "ax")


@query(f"""{_GLYPHS}, two AS (SELECT l_orderkey, min(pos) AS p, max(pos) AS q FROM g GROUP BY 1),
w AS (SELECT t.l_orderkey, a.cols / b.cols AS ratio FROM two t JOIN g a ON a.l_orderkey = t.l_orderkey AND a.pos = p JOIN g b ON b.l_orderkey = t.l_orderkey AND b.pos = q)
SELECT g.l_orderkey, pos, cols FROM g JOIN stats USING (l_orderkey) JOIN w USING (l_orderkey)
WHERE n >= 2 AND NOT (n = 2 AND ratio BETWEEN 0.7 AND 1.3) AND cols > average_width * CASE WHEN n <= 3 THEN 1.5 ELSE 2.0 END""")
def wide_chunks(spark, sf_dir):
    return layout.wide_chunks(_glyphs(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "pos", "cols")


_LIMITS = f"""{_GLYPHS}, s AS (SELECT l_orderkey, gap, row_number() OVER (PARTITION BY l_orderkey ORDER BY gap) AS k, count(*) OVER (PARTITION BY l_orderkey) AS m,
  lag(gap) OVER (PARTITION BY l_orderkey ORDER BY gap) AS p FROM gaps WHERE gap > 0),
best AS (SELECT l_orderkey, max(gap / p) AS ratio, arg_min((p + gap) / 2, struct_pack(a := -(gap / p), k := k)) AS mid FROM s WHERE p IS NOT NULL GROUP BY 1),
med AS (SELECT l_orderkey, gap AS median FROM s WHERE k = m // 2 + 1),
limits AS (SELECT l_orderkey, CASE WHEN median IS NULL THEN 2 WHEN ratio >= 1.8 THEN greatest(2, round(mid))
  ELSE greatest(2, round(median * 1.6), round(average_width * 0.4)) END::INT AS threshold
  FROM stats LEFT JOIN med USING (l_orderkey) LEFT JOIN best USING (l_orderkey))"""


@query(f"{_LIMITS} SELECT l_orderkey, threshold FROM limits")
def space_threshold(spark, sf_dir):
    g = _glyphs(spark, sf_dir)
    gap = F.col("x") - F.lag(F.col("x") + F.col("cols")).over(Window.partitionBy("l_orderkey").orderBy("pos"))
    gaps = g.withColumn("gap", gap).groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).alias("gaps"))
    both = gaps.join(layout.band_stats(g, ["l_orderkey"]), "l_orderkey")
    return both.select("l_orderkey", layout.space_threshold(F.col("gaps"), F.col("average_width")).alias("threshold"))


@query(f"""{_LIMITS}, e AS (SELECT g.*, lead(x) OVER (PARTITION BY l_orderkey ORDER BY pos) - x - cols AS ahead FROM g),
u AS (SELECT l_orderkey, pos, 0 AS after, x, cols, 'x' AS character FROM e
  UNION ALL SELECT l_orderkey, pos, 1, x + cols + 2, ahead - 4, ' ' FROM e JOIN limits USING (l_orderkey) WHERE ahead >= threshold AND ahead - 4 >= 2)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, after) - 1)::INT AS pos, x, cols, character FROM u""")
def insert_spaces(spark, sf_dir):
    return layout.insert_spaces(_glyphs(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "pos", "x", "cols", "character")


# ------------------------------------------------------------------ text


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))


_LINES = """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
q AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS line FROM p), lines AS (SELECT doc_id, line::INT AS line, s FROM q)"""
_SQL_LETTER = r"[\p{Lu}\p{Ll}\p{Lt}]"
_SQL_SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _n(s: str, pattern: str) -> str:
    return f"(length({s}) - length(regexp_replace({s}, '{pattern}', '', 'g')))"


@query(f"""{_LINES}, c AS (SELECT doc_id, line, length(s) AS n, {_n("s", _SQL_LETTER)} AS letters, {_n("s", "[0-9]")} AS digits, {_n("s", " ")} AS spaces, {_n("s", chr(92) + "p{Lu}")} AS up FROM lines)
SELECT doc_id, line, letters::INT AS letters, digits::INT AS digits, spaces::INT AS spaces, (up + n - letters - spaces)::INT AS uppercase, (letters - up)::INT AS lowercase FROM c""")
def char_stats(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("c", T.char_stats(F.col("s"))).select("doc_id", "line", "c.*")


_FIXED = f"""array_to_string([CASE WHEN {_n("w", "[0-9]")} > {_n("w", _SQL_LETTER)} THEN translate(w, 'oOilsSB', '0011558')
  ELSE replace(w, '0', CASE WHEN {_n("w", chr(92) + "p{Lu}")} * 2 > {_n("w", _SQL_LETTER)} THEN 'O' ELSE 'o' END) END FOR w IN string_split(s, ' ')], ' ')"""


@query(f"{_LINES} SELECT doc_id, line, {_FIXED} AS fixed FROM lines")
def fix_zeros(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", T.fix_zeros(F.col("s")).alias("fixed"))


@query(f"{_LINES} SELECT doc_id, line, len(regexp_extract_all(s, '[{_SQL_SPACE}]+|[.,!?;:]|[^{_SQL_SPACE}.,!?;:¤]+'))::BIGINT AS n_tokens FROM lines")
def token_counts(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", F.size(T.tokens(F.col("s"))).cast("long").alias("n_tokens"))


# Upper-cased, the sharp s is two letters; DuckDB keeps it.
_CASE = f"""CASE WHEN letters > 0 AND up + length(x) - letters - {_n("x", " ")} > letters - up THEN upper(replace(x, 'ß', 'SS'))
  WHEN letters > 0 THEN regexp_extract(x, '(?s)^([^{_SQL_LETTER[1:-1]}]*)', 1) || upper(replace(regexp_extract(x, '(?s)^[^{_SQL_LETTER[1:-1]}]*({_SQL_LETTER})', 1), 'ß', 'SS'))
    || lower(regexp_extract(x, '(?s)^[^{_SQL_LETTER[1:-1]}]*{_SQL_LETTER}(.*)$', 1)) ELSE x END"""


@query(f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+') AS l FROM documents),
q AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM p), c AS (SELECT *, {_n("x", _SQL_LETTER)} AS letters, {_n("x", chr(92) + "p{Lu}")} AS up FROM q),
j AS (SELECT doc_id, string_agg({_CASE}, '' ORDER BY i) AS t FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(t, '') AS cased FROM documents d LEFT JOIN j USING (doc_id)""")
def case_paragraph(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.case_paragraph(F.col("text")).alias("cased"))


_LINE_CASE = """CASE WHEN u + l < 3 THEN s WHEN u / (u + l) >= 0.9 THEN upper(replace(s, 'ß', 'SS'))
  WHEN l / (u + l) >= 0.9 AND regexp_matches(s, '^[^A-Za-z]*[a-z]') THEN regexp_extract(s, '(?s)^([^A-Za-z]*)', 1) || upper(regexp_extract(s, '(?s)^[^A-Za-z]*([a-z])', 1))
    || regexp_extract(s, '(?s)^[^A-Za-z]*[a-z](.*)$', 1) ELSE s END"""
_COUNTED = f"""SELECT *, {_n("s", "[A-Z]")}::DOUBLE AS u, {_n("s", "[a-z]")}::DOUBLE AS l FROM lines"""


@query(f"{_LINES}, c AS ({_COUNTED}) SELECT doc_id, line, {_LINE_CASE} AS cased FROM c")
def line_case(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", T.line_case(F.col("s")).alias("cased"))


_SEGMENTS = f"""array_to_string([CASE WHEN {_n("w", "[0-9]")} > 0 AND {_n("w", "[0-9]")} >= {_n("w", "[A-Za-z]")}
  AND regexp_matches(w, '^[A-Za-z0-9]') THEN translate(w, 'OoIlLtTZzAaSs', '0011111228855') ELSE w END FOR w IN regexp_extract_all(s, '[A-Za-z0-9]+|[^A-Za-z0-9]+')], '')"""


@query(f"{_LINES} SELECT doc_id, line, {_SEGMENTS} AS fixed FROM lines")
def digit_segments(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", T.digit_segments(F.col("s")).alias("fixed"))


# Without lookaround: strokes by the characters beside them; gaps in two passes, as a match takes the digit that the next begins with.
_STROKED = r"""CASE WHEN regexp_matches(s, '[0-9]') AND regexp_matches(s, '[\]\[|!]') THEN array_to_string(
  [CASE WHEN regexp_matches(ch[i], '[\]\[|!]') AND (regexp_matches(coalesce(ch[i + 1], ''), '^[0-9]') OR i > 1 AND regexp_matches(ch[i - 1], '^[0-9]')) THEN '1' ELSE ch[i] END FOR i IN range(1, len(ch) + 1)], '') ELSE s END"""
_GAP = f"regexp_replace(%s, '([0-9])[{_SQL_SPACE}]+([A-Za-z0-9][0-9])', '\\1.' || chr(57344) || '\\2', 'g')"
_POINTED = _GAP % (_GAP % "m")
for _digit, _letters in (("0", "Oo"), ("1", "IlLtT"), ("2", "Zz"), ("8", "Aa"), ("5", "Ss")):
    _POINTED = f"regexp_replace({_POINTED}, chr(57344) || '[{_letters}]', '{_digit}', 'g')"


def _gaps_sql(source: str) -> str:
    """CTEs of lines(doc_id, line, s) to gapless(doc_id, line, s)."""
    return f"""chars AS (SELECT *, regexp_extract_all(s, '(?s).') AS ch FROM {source}), mapped AS (SELECT doc_id, line, s, {_STROKED} AS m FROM chars),
gapless AS (SELECT doc_id, line, CASE WHEN regexp_matches(s, '[^0-9 \\t\\n\\r]') THEN replace({_POINTED}, chr(57344), '') ELSE regexp_replace(m, '[{_SQL_SPACE}]+', '', 'g') END AS s FROM mapped)"""


@query(f"{_LINES}, {_gaps_sql('lines')} SELECT doc_id, line, s AS fixed FROM gapless")
def numeric_gaps(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line", T.numeric_gaps(F.col("s")).alias("fixed"))


_NOISE = rf"^[{_SQL_SPACE}]*[ilILtT*\-_|!''`.,]{{0,2}}[{_SQL_SPACE}]*$"


def _quiet_sql(source: str) -> str:
    """CTEs of source(doc_id, line, s) to quiet(doc_id, n, t): the lines that aren't noise."""
    return f"""f AS (SELECT *, regexp_matches(s, '{_NOISE}') AS noise FROM {source}),
g AS (SELECT *, sum(CASE WHEN noise THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS k FROM f),
h AS (SELECT doc_id, k, bool_or(regexp_matches(s, '[ilIL|!]')) AS up, bool_or(regexp_matches(s, '[*\\-_]')) AS level FROM g WHERE noise GROUP BY 1, 2),
j AS (SELECT g.doc_id, g.line, CASE WHEN NOT regexp_matches(s, '^[a-z]') THEN '' WHEN up AND level THEN 'T' WHEN up THEN 'I' ELSE '' END || s AS t
  FROM g LEFT JOIN h ON h.doc_id = g.doc_id AND h.k = g.k - 1 WHERE NOT noise),
quiet AS (SELECT doc_id, count(*) AS n, string_agg(t, chr(10) ORDER BY line) AS t FROM j GROUP BY 1)"""


@query(f"{_LINES}, {_quiet_sql('lines')} SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(t, '') AS text FROM documents d LEFT JOIN quiet USING (doc_id)")
def noise_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("kept", T.drop_noise_lines(F.split("text", "\n")))
    return docs.select("doc_id", F.size("kept").cast("long").alias("n_lines"), F.array_join("kept", "\n").alias("text"))


def _closed_sql(t: str) -> str:
    visible = _n(t, "[^ \\t\\n\\r]")
    return f"""CASE WHEN {visible} > 0 AND {_n(t, "[A-Za-z0-9]")} / {visible} < 0.3 THEN regexp_replace({t}, '[{_SQL_SPACE}]+', '', 'g') ELSE {t} END"""


def _spaced_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '[{_SQL_SPACE}]+([,.;:!?])', '\\1', 'g'), '[{_SQL_SPACE}]+([)\\]}}])', '\\1', 'g')"


@query(f"SELECT doc_id, {_closed_sql('text')} AS closed FROM documents")
def punct_heavy(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.close_heavy_punctuation(F.col("text")).alias("closed"))


@query(f"SELECT doc_id, {_spaced_sql('text')} AS spaced FROM documents")
def punct_spacing(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.punctuation_spacing(F.col("text")).alias("spaced"))


@query(r"SELECT page_id, regexp_replace(html, '([A-Za-z])I\]([A-Za-z])', '\1H\2', 'g') AS fixed FROM pages")
def letter_confusion(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.letter_confusions(F.col("html")).alias("fixed"))


@query(f"SELECT page_id, regexp_replace(html, '[{_SQL_SPACE}]+', ' ', 'g') AS reduced, contains(html, ' ') AS spaced FROM pages")
def reduce_spaces(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.reduce_spaces(F.col("html")).alias("reduced"), T.contains_spaces(F.col("html")).alias("spaced"))


@query(f"""{_LINES}, cased AS (SELECT doc_id, line, {_LINE_CASE} AS s FROM ({_COUNTED})), {_gaps_sql('cased')},
numbered AS (SELECT doc_id, line, {_SEGMENTS} AS s FROM gapless), {_quiet_sql('numbered')},
shut AS (SELECT doc_id, {_closed_sql('t')} AS t FROM quiet), told AS (SELECT doc_id, regexp_replace(t, '([A-Za-z])I\\]([A-Za-z])', '\\1H\\2', 'g') AS t FROM shut)
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce({_spaced_sql('t')}, '') END AS text FROM documents d LEFT JOIN told USING (doc_id)""")
def post_process(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.post_process(F.col("text")).alias("text"))


_DICTIONARY = """WITH u AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM benchmark),
f AS (SELECT word, count(*) AS n FROM u GROUP BY 1), d AS (SELECT row_number() OVER (ORDER BY n DESC, word) - 1 AS idx, word FROM f)"""


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.words_of(_table(spark, sf_dir, "benchmark"), "text")


@query(f"""{_DICTIONARY}, w AS (SELECT DISTINCT n_name AS word FROM nation UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part),
p AS (SELECT w.word, d.word AS nearest, levenshtein(lower(w.word), d.word) AS d, row_number() OVER (PARTITION BY w.word ORDER BY levenshtein(lower(w.word), d.word), length(d.word) DESC, idx) AS k FROM w, d)
SELECT word, nearest, d::INT AS distance FROM p WHERE k = 1""")
def nearest_word(spark, sf_dir):
    words = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).union(_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " "))))
    return correction.nearest_words(words, _dictionary(spark, sf_dir))


_GUESSED = "[" + ", ".join(f"CASE WHEN contains(token, '{k}') THEN replace(token, '{k}', '{x}') END" for k, subs in correction.CONFUSIONS for x in subs) + "]"
# DuckDB's distance counts bytes; no word of the dictionary has others than a-z.
_ONE_BYTE = r"regexp_replace(lower(token), '[^\x00-\x7F]', chr(1), 'g')"
_TOKENS = f"[{_SQL_SPACE}]+|[.,!?;:]|[^{_SQL_SPACE}.,!?;:¤]+"


@query(f"""{_DICTIONARY}, p AS (SELECT item_id, string_split(text, chr(10)) AS l FROM benchmark),
q AS (SELECT item_id, unnest(l) AS s, unnest(range(len(l))) AS line FROM p), z AS (SELECT item_id, line, regexp_extract_all({_FIXED}, '{_TOKENS}') AS t FROM q),
t AS (SELECT item_id, line, unnest(t) AS token, unnest(range(len(t))) AS pos FROM z),
o AS (SELECT DISTINCT token FROM t WHERE length(token) > 1 AND {_n("token", "[0-9]")} <= {_n("token", _SQL_LETTER)} AND lower(token) NOT IN (SELECT word FROM d)),
g AS (SELECT token, unnest({_GUESSED}) AS g, unnest(range({sum(len(x) for _, x in correction.CONFUSIONS)})) AS i FROM o),
hit AS (SELECT token, arg_min(g.g, i) AS g FROM g JOIN d ON lower(g.g) = d.word GROUP BY 1), h AS (SELECT token, hit.g AS g FROM o LEFT JOIN hit USING (token)),
k AS (SELECT token, d.word AS g, row_number() OVER (PARTITION BY token ORDER BY levenshtein({_ONE_BYTE}, d.word), length(d.word) DESC, idx) AS k FROM h, d WHERE g IS NULL),
e AS (SELECT token, g || CASE WHEN right(token, 1) = 's' OR right(token, 1) = 'S' AND length(token) - 1 = length(g) THEN right(token, 1) ELSE '' END AS g FROM k WHERE k = 1),
f2 AS (SELECT token, g AS fixed FROM h WHERE g IS NOT NULL
  UNION ALL SELECT token, CASE WHEN length(token) = length(g) THEN array_to_string([CASE WHEN lower(token[i]) = lower(g[i]) THEN token[i] ELSE g[i] END FOR i IN range(1, length(token) + 1)], '') ELSE g END FROM e),
w AS (SELECT item_id, line, string_agg(coalesce(fixed, token), '' ORDER BY pos) AS s FROM t LEFT JOIN f2 USING (token) GROUP BY 1, 2),
y AS (SELECT item_id, line, regexp_extract_all(s, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+') AS l FROM w), v AS (SELECT item_id, line, unnest(l) AS x, unnest(range(len(l))) AS i FROM y),
c AS (SELECT *, {_n("x", _SQL_LETTER)} AS letters, {_n("x", chr(92) + "p{Lu}")} AS up FROM v), j AS (SELECT item_id, line, string_agg({_CASE}, '' ORDER BY i) AS s FROM c GROUP BY 1, 2),
a AS (SELECT q.item_id, string_agg(coalesce(j.s, ''), chr(10) ORDER BY q.line) AS corrected FROM q LEFT JOIN j USING (item_id, line) GROUP BY 1)
SELECT item_id, text, corrected FROM benchmark LEFT JOIN a USING (item_id)""")
def apply_correction(spark, sf_dir):
    return correction.apply_correction(_table(spark, sf_dir, "benchmark"), "text", "corrected", _dictionary(spark, sf_dir))


_CASES = """WITH c AS (SELECT item_id, text AS expected, translate(text, 'oOilsSB', '0011558') AS actual FROM benchmark)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("expected"), T.digit_correction(F.col("text")).alias("actual"))


@query(f"{_CASES} SELECT item_id, levenshtein(expected, actual)::INT AS distance, expected = actual AS exact, round(1 - levenshtein(expected, actual) / length(expected), 6) AS accuracy FROM c")
def char_accuracy(spark, sf_dir):
    scored = evaluate.per_case(_cases(spark, sf_dir))
    return scored.select("item_id", "distance", "exact", F.round("char_accuracy", 6).alias("accuracy"))


@query(f"{_CASES} SELECT count(*) AS n_cases, sum(length(expected))::BIGINT AS n_chars, sum(levenshtein(expected, actual))::BIGINT AS n_edits FROM c")
def overall_accuracy(spark, sf_dir):
    return evaluate.overall(evaluate.per_case(_cases(spark, sf_dir))).select("n_cases", "n_chars", "n_edits")


@query(f"""{_CASES} SELECT item_id, round(len([i FOR i IN range(1, length(expected) + 1) IF expected[i] = actual[i]]) * 100.0 / length(expected), 6)::DOUBLE AS percent FROM c""")
def positional_similarity(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return c.select("item_id", F.round(T.positional_similarity(F.col("expected"), F.col("actual")), 6).alias("percent"))


# ------------------------------------------------------------------ images


@query()
def template_training(spark, sf_dir):
    from inkfold.sources.render import stroke_templates

    return stroke_templates(spark)


@query()
def image_layout(spark, sf_dir):
    """Lines and glyphs of the rendered names of all suppliers."""
    from inkfold.plans.engine import Engine
    from inkfold.sources.render import rendered, stroke_templates

    grid = rendered(_table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", 28)
    glyphs = Engine(stroke_templates(spark)).layout(grid, "s_suppkey").select("s_suppkey", "band_id", F.posexplode("glyphs").alias("pos", "g"))
    return glyphs.select("s_suppkey", "band_id", "pos", "g.x", "g.y", "g.cols", "g.rows")


@query()
def image_to_text(spark, sf_dir):
    """The rendered names of all suppliers as PNG bytes, read back, with their accuracy."""
    from inkfold.plans.engine import Engine
    from inkfold.sources.png import decode_images, samples
    from inkfold.sources.render import rendered, stroke_templates

    images = samples(rendered(_table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", 28), "s_suppkey", "grid", "expected")
    read = Engine(stroke_templates(spark)).read_images(decode_images(images, "image_id", "media")).withColumnRenamed("text", "actual")
    return evaluate.per_case(read.join(images.select("image_id", "expected"), "image_id"))
