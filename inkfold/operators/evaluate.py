"""How well recognised text fits what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.functions.text import char_accuracy


def per_case(df: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    e, a = F.col(expected), F.coalesce(F.col(actual), F.lit(""))
    return df.withColumns({"distance": F.levenshtein(e, a), "char_accuracy": char_accuracy(e, a), "exact": e == a})


def overall(cases: DataFrame, expected: str = "expected") -> DataFrame:
    """One row: n, characters, edits, overall accuracy, share of exact cases."""
    return cases.agg(
        F.count("*").alias("n_cases"), F.sum(F.length(expected)).alias("n_chars"), F.sum("distance").cast("long").alias("n_edits"),
        (1 - F.sum("distance") / F.nullif(F.sum(F.length(expected)), F.lit(0))).alias("accuracy"), F.avg(F.col("exact").cast("double")).alias("exact_rate"),
    )


def aligned(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Characters of expected(key, text) beside found(key, text) by place; ' ' where nothing was found, '!' where
    nothing was expected."""
    e = expected.select(key, F.posexplode(F.split("text", "")).alias("pos", "expected"))
    f = found.select(key, F.posexplode(F.split("text", "")).alias("pos", "found"))
    both = f.join(e, [key, "pos"], "full_outer")
    return both.select(key, "pos", F.coalesce("found", F.lit(" ")).alias("found"), F.coalesce("expected", F.lit("!")).alias("expected")).withColumn("same", F.col("found") == F.col("expected"))


def region_profiles(cells: DataFrame, rects: DataFrame) -> DataFrame:
    """(grid_id, rect_id, x, n): ink by column within each rectangle, with zeros."""
    from inkfold.operators.grids import ID, crop

    every = rects.select(ID, "rect_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    found = crop(cells, rects).groupBy(ID, "rect_id", "x").agg(F.count("*").alias("n"))
    return every.join(found, [ID, "rect_id", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
