"""Sources of grids: ASCII pictures, flat and nested lists, points, image files. And their sinks.

A packed grid is struct(cols, rows, bits), a byte a cell. All conversions are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pack(flat: Column, cols: Column) -> Column:
    """From array<boolean> row by row; a last row that isn't whole is left out."""
    rows = F.when(cols > 0, F.floor(F.size(flat) / F.greatest(cols, F.lit(1)))).otherwise(0).cast("int")
    cells = F.slice(flat, F.lit(1), rows * cols)
    bits = F.unhex(F.array_join(F.transform(cells, lambda c: F.when(c, "01").otherwise("00")), ""))
    return F.struct(cols.cast("int").alias("cols"), rows.alias("rows"), bits.alias("bits"))


def from_ascii(rows: Column) -> Column:
    """From array<string>: '#' is ink; the first row's length is the width, missing cells are empty."""
    cols = F.when(F.size(rows) > 0, F.length(F.element_at(rows, 1))).otherwise(0)
    flat = F.flatten(F.transform(rows, lambda r: F.transform(F.split(F.rpad(r, cols, "."), ""), lambda c: c == "#")))
    return pack(F.when(cols > 0, flat).otherwise(F.array().cast("array<boolean>")), cols)


def from_ascii_text(text: Column) -> Column:
    return from_ascii(F.split(text, "\n"))


def from_nested(rows: Column) -> Column:
    """From array<array<boolean>>."""
    cols = F.when(F.size(rows) > 0, F.size(F.element_at(rows, 1))).otherwise(0)
    return pack(F.flatten(rows), cols)


def to_rows(grid: Column, on: str = "#", off: str = ".") -> Column:
    """array<string>, a row each."""
    text = F.replace(F.replace(F.hex(grid["bits"]), F.lit("01"), F.lit("#")), F.lit("00"), F.lit("."))
    text = F.translate(text, "#.", on + off)
    at = F.when(grid["rows"] > 0, F.sequence(F.lit(0), grid["rows"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda y: F.substring(text, y * grid["cols"] + 1, grid["cols"]))


def to_text(grid: Column, on: str = "#", off: str = ".", for_code: bool = False) -> Column:
    """One string with line ends; for_code quotes each row and ends it with a comma."""
    rows = to_rows(grid, on, off)
    if for_code:
        rows = F.transform(rows, lambda r: F.concat(F.lit('"'), r, F.lit('",')))
    return F.array_join(rows, "\n")


def to_json(grid: Column, font: Column, compat: bool = False) -> Column:
    """A matrix as JSON. compat repeats all rows once for each cell, as existing files do (T3)."""
    data = to_rows(grid)
    if compat:
        data = F.flatten(F.array_repeat(data, grid["rows"] * grid["cols"]))
    return F.to_json(F.struct(font.alias("font"), grid["rows"].alias("rows"), grid["cols"].alias("cols"), data.alias("data")))


def cells_of(df: DataFrame, id_col: str = "grid_id", grid_col: str = "grid") -> DataFrame:
    """(grid_id, x, y) of the inked cells of packed grids."""
    g = F.col(grid_col)
    at = F.posexplode(F.split(F.regexp_replace(F.hex(g["bits"]), "(..)", "$1 "), " "))
    return (
        df.select(F.col(id_col), g["cols"].alias("cols"), at.alias("i", "cell")).where("cell = '01'")
        .select(id_col, (F.col("i") % F.col("cols")).cast("int").alias("x"), F.floor(F.col("i") / F.col("cols")).cast("int").alias("y"))
    )


def grids_of_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Of points (keys, x, y): the box of each group and the points moved into it."""
    box = points.groupBy(*keys).agg(
        F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("cols"), (F.max("y") - F.min("y") + 1).alias("rows")
    )
    return points.join(box, keys).withColumns({"x": F.col("x") - F.col("left"), "y": F.col("y") - F.col("top")})


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, cols, rows, channels, data) from image files, decoded by the JVM. data is BGR, row by row."""
    image = spark.read.format("image").option("dropInvalid", False).load(path)
    return image.select(
        F.col("image.origin").alias("image_id"), F.col("image.width").alias("cols"), F.col("image.height").alias("rows"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def pixels_of(images: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b) from read_images()."""
    n = F.col("channels")
    at = F.explode(F.when(F.col("cols") * F.col("rows") > 0, F.sequence(F.lit(0), F.col("cols") * F.col("rows") - 1)))

    def byte(k: Column) -> Column:
        return F.conv(F.hex(F.substring(F.col("data"), F.col("i") * n + k + 1, F.lit(1))), 16, 10).cast("int")

    gray = n == 1
    return images.withColumn("i", at).select(
        "image_id", (F.col("i") % F.col("cols")).cast("int").alias("x"), F.floor(F.col("i") / F.col("cols")).cast("int").alias("y"),
        byte(F.when(gray, 0).otherwise(2)).alias("r"), byte(F.when(gray, 0).otherwise(1)).alias("g"), byte(F.lit(0)).alias("b"),
    )


def red_is_zero(pixels: DataFrame) -> DataFrame:
    """Inked cells of black-and-white pixels: those without red."""
    return pixels.where("r = 0").select("image_id", "x", "y")
