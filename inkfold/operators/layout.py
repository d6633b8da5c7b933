"""Layout operators that sets and windows can say; the order-dependent ones are in layout_kernels.py.

Glyphs are rows (band keys, pos, x, y, cols, rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkfold.functions import geometry as G
from inkfold.functions.text import let


def space_threshold(gaps: Column, average_width: Column) -> Column:
    """From array<int> of gaps above 0: between the two sorted gaps of the greatest ratio if that is 1.8 or more, else
    by the upper median and the average width; 2 at least."""

    def of(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.struct(
            (b / F.nullif(a, F.lit(0))).alias("ratio"), a.alias("a"), b.alias("b")))
        # The first of the greatest ratio: folds keep the earlier on ties.
        none = F.struct(F.lit(1.0).alias("ratio"), F.lit(0).alias("a"), F.lit(0).alias("b")).cast("struct<ratio:double,a:int,b:int>")
        best = F.aggregate(pairs, none, lambda acc, p: F.when(p["ratio"] > acc["ratio"], p.cast("struct<ratio:double,a:int,b:int>")).otherwise(acc))
        median = F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
        plain = F.greatest(F.lit(2), F.round(median * 1.6).cast("int"), F.round(average_width * 0.4).cast("int"))
        return let(best, lambda b: F.when(b["ratio"] >= 1.8, F.greatest(F.lit(2), F.round((b["a"] + b["b"]) / 2).cast("int"))).otherwise(plain))

    return F.when(F.size(gaps) == 0, F.lit(2)).otherwise(let(F.sort_array(gaps), of))


def band_stats(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, average_width, average_kerning); sums leave out the first glyph but are divided by all (T7)."""
    order = Window.partitionBy(*keys).orderBy("pos")
    gaps = glyphs.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("cols")).over(order)).withColumn("later", F.col("gap").isNotNull())
    n = F.count("*")
    return gaps.groupBy(*keys).agg(
        n.alias("n"),
        F.when(n < 2, F.max(F.col("x") + F.col("cols")) - F.min("x")).otherwise(F.round(F.sum(F.when(F.col("later"), F.col("cols"))) / n)).cast("int").alias("average_width"),
        F.when(n < 2, -1).otherwise(F.round(F.sum("gap") / n)).cast("int").alias("average_kerning"),
    )


def pack(glyphs: DataFrame, keys: list[str], kerning: int = 4) -> DataFrame:
    """Adjusted places: from the band's left, a kerning apart, at the first glyph's top."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    first = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return glyphs.withColumns({
        "ax": (F.min("x").over(whole) + F.coalesce(F.sum(F.col("cols") + kerning).over(before), F.lit(0))).cast("int"), "ay": F.first("y").over(first),
    })


def insert_spaces(glyphs: DataFrame, keys: list[str], border: int = 2, least: int = 2) -> DataFrame:
    """Glyphs with rows for spaces (character ' ') where a gap reaches the band's threshold; pos is numbered anew."""
    order = Window.partitionBy(*keys).orderBy("pos")
    with_gap = glyphs.withColumn("gap", F.lead("x").over(order) - F.col("x") - F.col("cols"))
    width = band_stats(glyphs, keys).select(*keys, "average_width")
    limits = with_gap.groupBy(*keys).agg(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))).alias("gaps"), F.min("y").alias("band_top"), F.max(F.col("y") + F.col("rows")).alias("band_bottom")).join(width, keys)
    limits = limits.select(*keys, space_threshold(F.col("gaps"), F.col("average_width")).alias("threshold"), (F.col("band_bottom") - F.col("band_top")).alias("band_rows"))
    own = F.struct("pos", F.lit(0).alias("after"), "x", "y", "cols", "rows", "character")
    gap = F.struct(
        F.col("pos"), F.lit(1).alias("after"), (F.col("x") + F.col("cols") + border).alias("x"), F.col("y"), (F.col("gap") - 2 * border).alias("cols"),
        F.col("band_rows").alias("rows"), F.lit(" ").alias("character"),
    )
    wide = (F.col("gap") >= F.col("threshold")) & (F.col("gap") - 2 * border >= least)
    rows = with_gap.join(limits, keys).select(*keys, F.explode(F.when(wide, F.array(own, gap)).otherwise(F.array(own))).alias("g"))
    again = Window.partitionBy(*keys).orderBy("g.pos", "g.after")
    return rows.select(*keys, (F.row_number().over(again) - 1).alias("pos"), "g.x", "g.y", "g.cols", "g.rows", "g.character")


def wide_chunks(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Glyphs far wider than their band's average."""
    stats = band_stats(glyphs, keys)
    pair = glyphs.groupBy(*keys).agg(F.min_by("cols", "pos").alias("a"), F.max_by("cols", "pos").alias("b"))
    alike = (F.col("n") == 2) & (F.col("a") / F.nullif("b", F.lit(0))).between(0.7, 1.3)
    limit = F.col("average_width") * F.when(F.col("n") <= 3, 1.5).otherwise(2.0)
    return glyphs.join(stats, keys).join(pair, keys).where((F.col("n") >= 2) & ~F.coalesce(alike, F.lit(False)) & (F.col("cols") > limit)).select(*glyphs.columns)


def row_islands(bands: DataFrame, key: str, order: str, rect: str = "rect") -> DataFrame:
    """bands with row_id: a band goes on with its predecessor's row if both are almost at one height."""
    w = Window.partitionBy(key).orderBy(order)
    new = ~F.coalesce(G.same_row(F.lag(rect).over(w), F.col(rect)), F.lit(False))
    return bands.withColumn("new_row", new.cast("int")).withColumn("row_id", F.sum("new_row").over(w) - 1).drop("new_row")


def nearest_rects(small: DataFrame, large: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, small_id, large_id, distance): for each small rectangle the nearest large one that it is within reach of;
    of equally near ones the first. Joined on key, so work is bounded by the rectangles of one key."""
    pairs = small.join(large, key).where(G.within_expanded(F.col("small"), F.col("large"), F.lit(reach)))
    best = F.min(F.struct(G.rect_distance(F.col("small"), F.col("large")).alias("d"), F.col("large_id").alias("id"))).alias("best")
    return pairs.groupBy(key, "small_id").agg(best).select(key, "small_id", F.col("best.id").alias("large_id"), F.col("best.d").alias("distance"))


def overlapping_rects(a: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """(key, a_id, b_id) with a_id < b_id whose common area is at least a share of the smaller one's."""
    b = a.select(key, F.col("id").alias("b_id"), F.col("rect").alias("b"))
    pairs = a.select(key, F.col("id").alias("a_id"), F.col("rect").alias("a")).join(b, key)
    return pairs.where((F.col("a_id") < F.col("b_id")) & G.should_merge(F.col("a"), F.col("b"), share)).select(key, "a_id", "b_id")


def band_text(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    chars = F.transform(F.array_sort(F.collect_list(F.struct("pos", "character"))), lambda g: g["character"])
    return glyphs.groupBy(*keys).agg(F.array_join(chars, "").alias("text"))


def total_artifacts(glyphs: DataFrame, key: str, band: str) -> DataFrame:
    """Glyphs plus one for each line's end but the last."""
    return glyphs.groupBy(key).agg((F.count("*") + F.countDistinct(band) - 1).alias("total"))
