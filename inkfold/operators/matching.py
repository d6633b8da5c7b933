"""Matching glyphs with templates over tables: prefilter, score, rank, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = ("enclosures", "is_punctuation", "line_left", "line_right")


def qualified(glyphs: DataFrame, templates: DataFrame, supported: str = "", quorum: int = 2, most: int = 5_000) -> DataFrame:
    """Pairs of a glyph and a template (FEATURES each) that agree in enough features.

    templates has a row for each character; its def_idx, character and features come to the driver and go into the plan, so
    nothing is joined."""
    rows = templates.select("def_idx", "character", *FEATURES).orderBy("def_idx").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    kinds = {f.name: f.dataType for f in templates.schema.fields}
    names = ("def_idx", "character", *FEATURES)
    chosen = [F.struct(*[F.lit(r[n]).cast(kinds[n]).alias(n) for n in names]) for r in rows if not supported or r["character"] in supported]
    if not chosen:
        return glyphs.limit(0).withColumns({n: F.lit(None).cast(kinds[n]) for n in names[:2]})
    agree = lambda t: sum((F.col(f).eqNullSafe(t[f]).cast("int") for f in FEATURES), F.lit(0)) >= quorum
    pairs = glyphs.withColumn("template", F.explode(F.filter(F.array(*chosen), agree)))
    return pairs.withColumns({n: F.col("template")[n] for n in names[:2]}).drop("template")


def packed_overlap(a: Column, b: Column) -> Column:
    """Common by either ink of two array<bigint> of bits; 0 if either is none or the lengths differ."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, n: s + n)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(0.0)))


def pack_bits(cells: Column) -> Column:
    """array<bigint> of bits from array<boolean>, 64 to a number, the first one lowest."""
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(cells) - 1) / 64).cast("int")))

    def number(k: Column) -> Column:
        bits = F.transform(F.slice(cells, k * 64 + 1, F.lit(64)), lambda c, i: F.when(c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(F.size(cells) > 0, F.transform(parts, number)).otherwise(F.array().cast("array<bigint>"))


def best_template(bits: Column, templates: DataFrame, most: int = 5_000) -> Column:
    """struct(template_id, both, either) of the template with the greatest overlap with packed bits, the first by id of equals;
    null without common ink. templates(template_id, bits) come to the driver, as they do for the engine, and go into the plan."""
    rows = templates.select(F.col("template_id").cast("long").alias("template_id"), "bits").orderBy("template_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    if not rows:
        return F.lit(None).cast("struct<score:double,id:bigint,both:int,either:int>")
    table = F.array(*[F.struct(F.lit(r["template_id"]).cast("long").alias("id"), F.array(*[F.lit(b).cast("long") for b in r["bits"]]).cast("array<bigint>").alias("bits")) for r in rows])

    def count(a: Column, b: Column, op: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(getattr(x, op)(y))), F.lit(0), lambda s, n: s + n)

    scored = F.transform(
        F.filter(table, lambda t: F.size(t["bits"]) == F.size(bits)),
        lambda t: F.struct(t["id"].alias("id"), count(bits, t["bits"], "bitwiseAND").alias("both"), count(bits, t["bits"], "bitwiseOR").alias("either")),
    )
    ranked = F.transform(
        F.filter(scored, lambda x: x["both"] > 0),
        lambda x: F.struct((-x["both"] / x["either"]).alias("less"), x["id"].alias("template_id"), x["both"].alias("both"), x["either"].alias("either")),
    )
    return F.array_min(ranked)


def combine(scored: DataFrame, key: str) -> DataFrame:
    """(key, def_idx, character, matrix_index, score) from (.., matrix_index, iou): 0.7 of the best and 0.3 of the mean."""
    best = F.struct(F.col("iou"), (-F.col("matrix_index")).alias("i"))
    return scored.groupBy(key, "def_idx", "character").agg(
        F.max_by("matrix_index", best).alias("matrix_index"), (F.max("iou") * 0.7 + F.avg("iou") * 0.3).alias("score")
    )


def ranked(scores: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """scores with rank from 1: by score, then by the order of templates."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "def_idx")
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def promoted(ranks: DataFrame, key: str) -> DataFrame:
    """Ranks after promotions; ranks has lower_right, aspect and n_stems of its glyph in every row.

    First R before a near P where there is a lower right stroke, then u before m where it is narrow."""

    def raise_(df: DataFrame, heads: str, others: str, allowed: Column) -> DataFrame:
        whole = Window.partitionBy(key)
        head = F.max(F.when(F.col("rank") == 1, F.struct("character", "score"))).over(whole)
        other = F.min(F.when(F.contains(F.lit(others), F.col("character")), F.struct("rank", "score"))).over(whole)
        both = df.withColumns({"h": head, "o": other})
        gap = F.col("h.score") - F.col("o.score")
        go = F.contains(F.lit(heads), F.col("h.character")) & F.col("o").isNotNull() & allowed_of(allowed, gap)
        moved = F.when(F.col("rank") == F.col("o.rank"), 1).when(F.col("rank") < F.col("o.rank"), F.col("rank") + 1).otherwise(F.col("rank"))
        return both.withColumn("rank", F.when(F.coalesce(go, F.lit(False)), moved).otherwise(F.col("rank"))).drop("h", "o")

    def allowed_of(rule, gap: Column) -> Column:
        return rule(gap)

    first = raise_(ranks, "Pp", "Rr", lambda gap: F.col("lower_right") & (gap <= 0.06))
    return raise_(first, "m", "u", lambda gap: (F.col("n_stems") <= 2) | ((F.col("aspect") < 1.05) & (gap <= 0.08)))
