"""The table of templates: reading, writing, upserting, and training on rendered glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.schema import TEMPLATE

# The characters that can be recognised.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
PUNCTUATION = " .,?!:;'\"(){}[]<>-"
OTHERS = "/\\+=#$&*@"
SUPPORTED = UPPER + LOWER + DIGITS + PUNCTUATION + OTHERS


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each template of files {"templates": [...]}; a broken file fails."""
    files = spark.read.schema(f"templates array<{TEMPLATE}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return files.select(F.posexplode("templates").alias("def_idx", "t")).select("def_idx", "t.*")


def parse_templates(text: Column) -> Column:
    return F.from_json(text, f"struct<templates:array<{TEMPLATE}>>", {"mode": "FAILFAST"})["templates"]


def templates_json(templates: DataFrame) -> DataFrame:
    """One row, one string: all templates by character. It is a small table by nature."""
    fields = [f for f in templates.columns if f != "def_idx"]
    rows = F.array_sort(F.collect_list(F.struct(*fields)))
    return templates.agg(F.to_json(F.struct(rows.alias("templates"))).alias("json"))


def get_definition(templates: DataFrame, character: str) -> DataFrame:
    """The first template of a character, if there is one."""
    return templates.where(F.col("character") == character).orderBy("def_idx").limit(1)


def get_matrix(templates: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(character, index) with matrix; an empty one (0 x 0) where there is none."""
    first = templates.groupBy("character").agg(F.min_by("matrices", "def_idx").alias("matrices"))
    empty = F.struct(F.lit(None).cast("string").alias("font"), F.lit(0).alias("rows"), F.lit(0).alias("cols"), F.array().cast("array<string>").alias("data"))
    found = F.when(F.col("index") >= 0, F.get("matrices", F.col("index")))
    return asked.join(first, "character", "left").withColumn("matrix", F.coalesce(found, empty)).drop("matrices")


def upsert_templates(templates: DataFrame, fresh: DataFrame) -> DataFrame:
    """templates with fresh(character, font, rows, cols, data, ord) merged in by character and font, and is_new.

    Of fresh rows with one character and font the last by ord counts. A known font's matrix is replaced in its place;
    others are appended by ord. Features of known characters stay; new ones get none.
    """
    last = fresh.groupBy("character", "font").agg(F.max_by(F.struct("font", "rows", "cols", "data"), "ord").alias("m"), F.max("ord").alias("ord"))
    news = last.groupBy("character").agg(F.array_sort(F.collect_list(F.struct("ord", "m"))).alias("news"), F.min("ord").alias("first"))
    both = templates.withColumn("known", F.lit(True)).join(news, "character", "full_outer")
    old = F.coalesce("matrices", F.array().cast("array<struct<font:string,rows:int,cols:int,data:array<string>>>"))
    new = F.coalesce(F.transform("news", lambda x: x["m"]), F.array().cast("array<struct<font:string,rows:int,cols:int,data:array<string>>>"))
    kept = F.transform(old, lambda m: F.coalesce(F.get(F.filter(new, lambda n: n["font"] == m["font"]), F.lit(0)), m))
    added = F.filter(new, lambda n: ~F.exists(old, lambda m: m["font"] == n["font"]))
    most = templates.agg(F.coalesce(F.max("def_idx") + 1, F.lit(0)).alias("base"))
    out = both.withColumn("matrices", F.concat(kept, added)).join(F.broadcast(most))
    flags = [c for c in templates.columns if c not in ("def_idx", "character", "matrices")]
    return out.select(
        F.coalesce("def_idx", (F.col("base") + F.col("first")).cast("int")).alias("def_idx"), "character",
        *[F.coalesce(F.col(c), F.lit(0 if c == "enclosures" else False)).alias(c) for c in flags],
        "matrices", F.col("known").isNull().alias("is_new"),
    )
