"""Training templates: each character is drawn between two others, laid out, and the middle glyph normalised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators import kernels as K
from inkfold.operators import layout_kernels as L


def middle_glyph(character: str, height: int, pen: float, slant: float) -> np.ndarray | None:
    """The glyph of "A c W" between both letters, at its band's height; None unless there is one band of three."""
    from inkfold.sources.render import draw_text

    bands = L.layout(draw_text(f"A {character} W", height, 12, pen, slant), inner_split=False)
    if len(bands) != 1:
        return None
    inked = [g for g in bands[0].glyphs if g.character != " " and g.grid.any()]
    return inked[1].grid if len(inked) == 3 else None


def train_templates(wanted: DataFrame, height: int = 40) -> DataFrame:
    """The table of templates from wanted(font, character, ord, pen, slant); characters whose layout isn't one glyph
    are drawn alone. Features are those of the first font."""

    def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from inkfold.sources.render import draw

        for p in parts:
            rows = []
            for r in p.itertuples():
                grid = middle_glyph(r.character, height, r.pen, r.slant)
                grid = draw(r.character, height, r.pen, r.slant) if grid is None else grid
                e, punctuation, left, right = L.match_features(grid)
                data = ["".join("#" if c else "." for c in row) for row in K.normalise(grid)]
                rows.append((r.font, r.character, r.ord, e, bool(punctuation), bool(left), bool(right), data))
            yield pd.DataFrame(rows, columns=["font", "character", "ord", "enclosures", "punctuation", "line_left", "line_right", "data"])

    made = wanted.mapInPandas(
        train, "font string, character string, ord int, enclosures int, punctuation boolean, line_left boolean, line_right boolean, data array<string>"
    )
    fonts = F.array_sort(F.collect_list(F.struct(F.when(F.col("font") == "plain", 0).otherwise(1).alias("o"), "font", "data", "enclosures", "punctuation", "line_left", "line_right")))
    first = F.element_at("fonts", 1)
    c = F.col("character")
    return made.groupBy("character").agg(F.min("ord").alias("def_idx"), fonts.alias("fonts")).select(
        "def_idx", "character", first["enclosures"].alias("enclosures"), first["line_left"].alias("lineLeft"), first["line_right"].alias("lineRight"),
        F.lit(False).alias("isAmount"), F.lit(False).alias("isDate"), c.rlike("^[0-9]$").alias("isDigit"), c.rlike("^[A-Za-z]$").alias("isLetter"),
        first["punctuation"].alias("isPunctuation"),
        F.transform("fonts", lambda f: F.struct(f["font"].alias("font"), F.lit(K.TEMPLATE_ROWS).alias("rows"), F.lit(K.TEMPLATE_COLS).alias("cols"), f["data"].alias("data"))).alias("matrices"),
    )
