"""Grid operators over tables of cells, with DataFrame operations; components and enclosures end in an Arrow step.

cells is (grid_id, x, y): the inked cells; sizes is (grid_id, cols, rows). Work is spread by grid, and every
aggregate is partial before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkfold.operators.kernels import LINE_HIGH, LINE_LOW, MAX_SPECK, PUNCTUATION_HEIGHT, VALLEY_DEPTH, VALLEY_WINDOW, cell_components, many_enclosures

ID = "grid_id"
#: An Arrow step labels about so many cells at once, or one larger grid.
HELD_CELLS = 1 << 18


def luma(r: Column, g: Column, b: Column, contrast: float = 0.0) -> Column:
    """Grey level 0..255 with contrast stretched around 128."""
    gray = F.floor(F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b)
    factor = 259 * (contrast + 255) / (255 * (259 - contrast))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.lit(factor) * (gray - 128) + 128))).cast("int")


def otsu_thresholds(levels: DataFrame, key: str, level: str) -> DataFrame:
    """(key, threshold) from rows of grey levels: the first of the greatest variance between classes, else 128."""
    counts = levels.groupBy(key, F.col(level).cast("int").alias("level")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy("level")
    whole = Window.partitionBy(key)
    split = (
        counts.withColumns({
            "wb": F.sum("n").over(upto).cast("double"), "sb": F.sum(F.col("n") * F.col("level")).over(upto).cast("double"),
            "w": F.sum("n").over(whole).cast("double"), "s": F.sum(F.col("n") * F.col("level")).over(whole).cast("double"),
        })
        .withColumn("wf", F.col("w") - F.col("wb"))
    )
    d = F.col("sb") / F.nullif("wb", F.lit(0.0)) - (F.col("s") - F.col("sb")) / F.nullif("wf", F.lit(0.0))
    spread = F.when(F.col("wf") > 0, F.col("wb") * F.col("wf") * d * d)
    best = split.withColumn("spread", spread).groupBy(key).agg(F.max_by("level", F.when(F.col("spread") > 0, F.struct(F.col("spread"), -F.col("level")))).alias("threshold"))
    return best.select(key, F.coalesce("threshold", F.lit(128)).alias("threshold"))


def binarize(pixels: DataFrame, key: str = "image_id", contrast: float = 0.0) -> DataFrame:
    """Inked cells (key, x, y) of pixels (key, x, y, r, g, b): those not brighter than Otsu's threshold."""
    gray = pixels.withColumn("level", luma(F.col("r"), F.col("g"), F.col("b"), contrast))
    # One row an image; still joined by shuffle beyond Spark's own limit.
    return gray.join(otsu_thresholds(gray, key, "level"), key).where("level <= threshold").select(key, "x", "y")


def count_on(cells: DataFrame) -> DataFrame:
    return cells.groupBy(ID).agg(F.count("*").alias("n_on"))


def content_rect(cells: DataFrame) -> DataFrame:
    return cells.groupBy(ID).agg(
        F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height")
    )


def profile(cells: DataFrame, sizes: DataFrame, axis: str) -> DataFrame:
    """(grid_id, axis, n) with zeros: ink by column (x) or row (y)."""
    n = F.col("cols" if axis == "x" else "rows")
    every = sizes.where(n > 0).select(ID, F.explode(F.sequence(F.lit(0), n - 1)).alias(axis))
    found = cells.groupBy(ID, axis).agg(F.count("*").alias("n"))
    return every.join(found, [ID, axis], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _neighbours(cells: DataFrame, half: int) -> DataFrame:
    step = F.sequence(F.lit(-half), F.lit(half))
    return cells.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")})


def dilate(cells: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """A square maximum, one axis after the other, clipped to the grid."""
    step = F.sequence(F.lit(-(size // 2)), F.lit(size // 2))
    wide = cells.withColumn("d", F.explode(step)).select(ID, (F.col("x") + F.col("d")).alias("x"), "y").distinct()
    both = wide.withColumn("d", F.explode(step)).select(ID, "x", (F.col("y") + F.col("d")).alias("y")).distinct().join(sizes, ID)
    return both.where("x >= 0 and y >= 0 and x < cols and y < rows").select(ID, "x", "y")


def erode_soft(cells: DataFrame, least: int = 5) -> DataFrame:
    """Ink with at least so many inked cells in its 3 x 3, itself included."""
    around = _neighbours(cells, 1).groupBy(ID, "x", "y").agg(F.count("*").alias("n"))
    return cells.join(around.where(F.col("n") >= least), [ID, "x", "y"], "left_semi")


def trim(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells moved to the origin, and their sizes; a grid without ink disappears (0 x 0)."""
    box = content_rect(cells)
    moved = cells.join(box, ID).select(ID, (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"))
    return moved, box.select(ID, F.col("width").alias("cols"), F.col("height").alias("rows"))


def pad(cells: DataFrame, sizes: DataFrame, top: int, bottom: int) -> tuple[DataFrame, DataFrame]:
    return cells.withColumn("y", F.col("y") + top), sizes.withColumn("rows", F.col("rows") + top + bottom)


def wrap(cells: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty border of one cell."""
    return (
        cells.withColumns({"x": F.col("x") + 1, "y": F.col("y") + 1}),
        sizes.withColumns({"cols": F.col("cols") + 2, "rows": F.col("rows") + 2}),
    )


def crop(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """(grid_id, rect_id, x, y): cells inside rects(grid_id, rect_id, left, top, width, height), moved to the origin."""
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + F.col("width")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + F.col("height"))
    return cells.join(rects, ID).where(inside).select(ID, "rect_id", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"))


def paste(base: DataFrame, other: DataFrame, dx: int, dy: int) -> DataFrame:
    """Ink of either, other moved by dx, dy."""
    return base.select(ID, "x", "y").unionByName(other.select(ID, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))).distinct()


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """One grid of two pieces: (grid_id, at_x, at_y, x, y) each; cells of the box around both."""
    both = a.unionByName(b).select(ID, (F.col("x") + F.col("at_x")).alias("x"), (F.col("y") + F.col("at_y")).alias("y")).distinct()
    corner = a.select(ID, "at_x", "at_y").unionByName(b.select(ID, "at_x", "at_y")).groupBy(ID).agg(F.min("at_x").alias("l"), F.min("at_y").alias("t"))
    return both.join(corner, ID).select(ID, (F.col("x") - F.col("l")).alias("x"), (F.col("y") - F.col("t")).alias("y"))


def clear(cells: DataFrame) -> DataFrame:
    """No ink at all."""
    return cells.limit(0)


def set_cells(cells: DataFrame, sizes: DataFrame, marks: DataFrame) -> DataFrame:
    """cells after marks(grid_id, x, y, on boolean), of which those outside of the grid change nothing. Of marks on one cell ink wins."""
    inside = marks.join(sizes, ID).where("x >= 0 and y >= 0 and x < cols and y < rows").groupBy(ID, "x", "y").agg(F.max("on").alias("on"))
    kept = cells.select(ID, "x", "y").join(inside, [ID, "x", "y"], "left_anti")
    return kept.unionByName(inside.where("on").select(ID, "x", "y"))


def translate(cells: DataFrame, dx: int, dy: int) -> DataFrame:
    """Cells moved; a piece's place isn't bounded by its grid."""
    return cells.select(ID, (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))


def shape_tests(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grid_id, is_empty, is_line, is_speck, is_punctuation): by the ink's box; a speck is a grid of two cells or a line."""
    box = content_rect(cells)
    high, wide = F.col("height"), F.col("width")
    inked = wide.isNotNull()
    line = F.coalesce(inked & ~(high / wide).between(LINE_LOW, LINE_HIGH), F.lit(False))
    both = sizes.join(box, ID, "left").withColumn("is_line", line)
    return both.select(
        ID, (~inked).alias("is_empty"), "is_line", (F.col("is_line") | (F.col("cols") * F.col("rows") <= MAX_SPECK)).alias("is_speck"),
        F.coalesce(inked & (high < F.col("rows") * PUNCTUATION_HEIGHT), F.lit(False)).alias("is_punctuation"),
    )


def fill_threshold(density: Column) -> Column:
    return F.when(density <= 0.2, 0.25).when(density >= 0.5, 0.45).otherwise(0.25 + 0.2 * ((density - 0.2) / 0.3))


def resize(cells: DataFrame, sizes: DataFrame, cols: int, rows: int, fill: float = 0.3) -> DataFrame:
    """Nearest cell if either side grows, else ink where the share of the covered cells reaches fill."""
    sx, sy = F.col("cols") / F.lit(float(cols)), F.col("rows") / F.lit(float(rows))
    grid = (
        sizes.where("cols > 0 and rows > 0").withColumn("tx", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        .withColumn("grows", (F.col("cols") < cols) | (F.col("rows") < rows))
        .withColumns({"x0": F.floor(F.col("tx") * sx), "y0": F.floor(F.col("ty") * sy)})
        .withColumns({
            "x1": F.when(F.col("grows"), F.col("x0") + 1).otherwise(F.least(F.ceil(F.col("tx") * sx + sx), F.col("cols"))),
            "y1": F.when(F.col("grows"), F.col("y0") + 1).otherwise(F.least(F.ceil(F.col("ty") * sy + sy), F.col("rows"))),
        })
    )
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    covered = grid.withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    ink = covered.join(cells, [ID, "x", "y"]).groupBy(ID, "tx", "ty", "grows", area.alias("area")).agg(F.count("*").alias("n"))
    return ink.where(F.col("grows") | (F.col("n") / F.col("area") >= fill)).select(ID, F.col("tx").alias("x"), F.col("ty").alias("y"))


def vertical_line(cells: DataFrame, sizes: DataFrame, side: str, share: float = 0.7) -> DataFrame:
    """(grid_id, has_line): whether some column has a run of ink, empty beside it on that side, of share of the rows."""
    step = -1 if side == "left" else 1
    beside = cells.select(ID, (F.col("x") - step).alias("x"), "y")
    free = cells.join(beside, [ID, "x", "y"], "left_anti")
    column = Window.partitionBy(ID, "x").orderBy("y")
    runs = free.withColumn("island", F.col("y") - F.row_number().over(column)).groupBy(ID, "x", "island").agg(F.count("*").alias("run"))
    most = runs.groupBy(ID).agg(F.max("run").alias("run"))
    any_ink = cells.select(ID).distinct().withColumn("inked", F.lit(True))
    need = F.floor(F.col("rows") * share)
    return (
        sizes.join(most, ID, "left").join(any_ink, ID, "left")
        .select(ID, (F.coalesce("inked", F.lit(False)) & (F.coalesce("run", F.lit(0)) >= need)).alias("has_line"))
    )


def stems(cells: DataFrame) -> DataFrame:
    """(grid_id, n_stems): runs of columns with at least 0.8 of the fullest column's ink."""
    column = cells.groupBy(ID, "x").agg(F.count("*").alias("n"))
    whole, order = Window.partitionBy(ID), Window.partitionBy(ID).orderBy("x")
    tall = column.withColumn("limit", F.greatest(F.lit(1), F.round(F.max("n").over(whole) * 0.8))).where("n >= limit")
    starts = tall.withColumn("first", F.coalesce(F.col("x") - F.lag("x").over(order) > 1, F.lit(True)))
    return starts.groupBy(ID).agg(F.sum(F.col("first").cast("long")).alias("n_stems"))


def lower_right_stroke(cells: DataFrame) -> DataFrame:
    """(grid_id, has_stroke): whether the lower right of the content is dense for the whole."""
    box = content_rect(cells)
    x0, y0 = F.col("left") + F.round(F.col("width") * 0.55), F.col("top") + F.round(F.col("height") * 0.55)
    inside = (F.col("x") >= x0) & (F.col("y") >= y0)
    area = (F.col("left") + F.col("width") - x0) * (F.col("top") + F.col("height") - y0)
    ink = cells.join(box, ID).groupBy(ID, area.alias("part"), (F.col("width") * F.col("height")).alias("whole")).agg(
        F.count("*").alias("n"), F.sum(F.when(inside, 1).otherwise(0)).alias("m")
    )
    return ink.select(ID, F.coalesce((F.col("part") > 0) & (F.col("m") / F.nullif("part", F.lit(0)) >= F.col("n") / F.col("whole") * 0.6), F.lit(False)).alias("has_stroke"))


def _parts(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about HELD_CELLS, of which a row has so many as size says."""
    for b in batches:
        cuts = (np.flatnonzero(np.diff(np.cumsum(size(b)) // HELD_CELLS)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def _held(lists: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, x, y) of the cells in lists of them, which may be null."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    cells = lists.flatten()
    return np.repeat(np.arange(len(n)), n), pc.struct_field(cells, "x"), pc.struct_field(cells, "y")


def _longs(v: pa.Array) -> np.ndarray:
    return pc.cast(v, pa.int64()).to_numpy(zero_copy_only=False)


def _lists(cells: DataFrame) -> DataFrame:
    """(grid_id, cells): a row for each grid with ink, so that a grid meets in one row whatever its id's type."""
    return cells.where(F.col(ID).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(ID).agg(F.collect_list(F.struct("x", "y")).alias("cells"))


def components(cells: DataFrame, diagonal: bool) -> DataFrame:
    """(grid_id, x, y, label): label is the raster place y * 2**20 + x of the component's first cell.

    Each grid's cells come together in one row and are labelled in one Arrow step, many grids at once; no rounds, joins or
    tables between, and nothing goes to the driver. So a grid has to fit into a row (some ten million inked cells); images
    go through labels() of kernels.py. A repeated cell is one cell. Cells of a null grid touch nothing.
    """
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, lambda b: pc.list_value_length(b["cells"]).to_numpy(zero_copy_only=False).astype(np.int64)):
            row, x, y = _held(b["cells"])
            xs, ys = _longs(x), _longs(y)
            order, first = cell_components(row, xs, ys, diagonal)
            at = pa.array(order)
            yield pa.record_batch([b[ID].take(pa.array(row[order])), x.take(at), y.take(at), pa.array((ys[first] << 20) + xs[first])], names=[ID, "x", "y", "label"])

    cells = cells.select(ID, "x", "y")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in cells.schema], T.StructField("label", T.LongType())])
    # Apart, as a null key would bring all of them to one task.
    alone = cells.where(F.col(ID).isNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()
    return _lists(cells).mapInArrow(label, schema).unionByName(alone.withColumn("label", F.shiftleft(F.col("y").cast("long"), 20) + F.col("x")))


def component_boxes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(ID, "label").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("n")
    )


def enclosures(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grid_id, enclosures): holes of at least 3 cells and a hundredth of the grid, off the border. A grid has to fit into a row."""
    def counts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_longs(pc.fill_null(b[c], 0)) for c in ("cols", "rows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, lambda b: np.prod(counts(b), axis=0)):
            row, x, y = _held(b["cells"])
            yield pa.record_batch([b[ID], pa.array(many_enclosures(*counts(b), row, _longs(x), _longs(y)))], names=[ID, "enclosures"])

    schema = T.StructType([T.StructField(ID, sizes.schema[ID].dataType), T.StructField("enclosures", T.LongType())])
    # Never broadcast: lists of cells are larger than what is estimated from the files.
    return sizes.select(ID, "cols", "rows").join(_lists(cells).hint("merge"), ID, "left").mapInArrow(count, schema)


def valley_threshold(bins: DataFrame, key: str, at: str = "x", n: str = "n") -> DataFrame:
    """(key, threshold) from gapless bins: 1.2 times the lowest inner run lower than both neighbours, cut; else -1."""
    order = Window.partitionBy(key).orderBy(at)
    runs = (
        bins.withColumn("new", F.coalesce((F.col(n) != F.lag(n).over(order)).cast("int"), F.lit(0)))
        .withColumn("run", F.sum("new").over(order)).groupBy(key, "run").agg(F.first(n).alias("v"))
    )
    by_run = Window.partitionBy(key).orderBy("run")
    low = runs.withColumns({"before": F.lag("v").over(by_run), "behind": F.lead("v").over(by_run)}).withColumn(
        "valley", F.when((F.col("v") < F.col("before")) & (F.col("v") < F.col("behind")), F.col("v"))
    )
    return low.groupBy(key).agg(F.min("valley").alias("least")).select(key, F.coalesce(F.floor(F.col("least") * 1.2), F.lit(-1)).cast("long").alias("threshold"))


def soft_valleys(bins: DataFrame, key: str, at: str = "x", n: str = "n") -> DataFrame:
    """(key, valley) from gapless bins that count from 0: middles of level runs, off the borders, that are no higher than what
    is before them (a run of one: and behind it) and at most VALLEY_DEPTH of the lower of the peaks VALLEY_WINDOW bins to each side."""
    order = Window.partitionBy(key).orderBy(at)
    told = bins.withColumns({
        "new": F.coalesce((F.col(n) != F.lag(n).over(order)).cast("int"), F.lit(0)),
        "left_peak": F.max(n).over(order.rowsBetween(-VALLEY_WINDOW, -1)), "right_peak": F.max(n).over(order.rowsBetween(1, VALLEY_WINDOW)),
        "before": F.lag(n).over(order), "behind": F.lead(n).over(order),
    }).withColumn("run", F.sum("new").over(order))
    runs = told.groupBy(key, "run").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.first(n).alias("v"), F.min_by("before", at).alias("before"), F.max_by("behind", at).alias("behind"),
        F.min_by("left_peak", at).alias("left_peak"), F.max_by("right_peak", at).alias("right_peak"),
    )
    peak = F.least("left_peak", "right_peak")
    low = (F.col("v") <= F.col("before")) & F.col("behind").isNotNull() & ((F.col("last") > F.col("first")) | (F.col("v") <= F.col("behind"))) & (peak > 0) & (F.col("v") <= F.floor(peak * VALLEY_DEPTH + 0.5))
    return runs.where(low).select(key, (F.col("first") + F.floor((F.col("last") - F.col("first")) / 2)).cast("int").alias("valley"))


def split_columns(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """(grid_id, part, x, y) by cuts(grid_id, offsets array<int>): parts count from 0, each moved to its first column."""
    part = F.size(F.filter("offsets", lambda o: o <= F.col("x")))
    start = F.when(part > 0, F.element_at("offsets", F.greatest(part, F.lit(1)))).otherwise(0)
    return cells.join(cuts, ID).where(F.size("offsets") > 0).select(ID, part.alias("part"), (F.col("x") - start).alias("x"), "y")


def overlap_scores(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """(grid_id, template_id, both, either) for every pair of a grid and a template (template_id, x, y) with common ink.

    Joined on the cell; templates are a bounded table, so candidates per grid are as well."""
    n = cells.groupBy(ID).agg(F.count("*").alias("n"))
    m = templates.groupBy("template_id").agg(F.count("*").alias("m"))
    both = cells.join(templates, ["x", "y"]).groupBy(ID, "template_id").agg(F.count("*").alias("both"))
    return both.join(n, ID).join(m, "template_id").select(ID, "template_id", "both", (F.col("n") + F.col("m") - F.col("both")).alias("either"))
