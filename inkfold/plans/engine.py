"""The engine: tables of images in, tables of text out.

A plan is one Arrow step per image for layout and recognition, with templates as a closure (about a hundred
characters, so a few hundred kilobytes), then column expressions for the text. Nothing is shuffled but the tokens
that meet a dictionary. Images are independent, so partitions follow the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.config import BALANCED, Config
from inkfold.functions.text import post_process
from inkfold.operators import kernels as K
from inkfold.operators import layout_kernels as L
from inkfold.operators.correction import apply_correction
from inkfold.schema import GLYPH


def _grid(g) -> np.ndarray:
    return np.frombuffer(g["bits"] or b"", np.uint8).reshape(int(g["rows"]), int(g["cols"])).astype(bool)


def _glyph_row(g: L.Glyph) -> dict:
    return {
        "x": g.x, "y": g.y, "ax": g.ax, "ay": g.ay, "cols": g.cols, "rows": g.rows, "character": g.character, "score": g.score,
        "needs_inspection": bool(g.inspect), "was_part_of_split": bool(g.was_split), "bits": g.grid.astype(np.uint8).tobytes(),
    }


def _glyph(r: dict) -> L.Glyph:
    grid = np.frombuffer(r["bits"], np.uint8).reshape(r["rows"], r["cols"]).astype(bool)
    return L.Glyph(grid, r["x"], r["y"], r["ax"], r["ay"], r["character"], r["score"], r["needs_inspection"], r["was_part_of_split"])


class Engine:
    """templates is the table of sources/templates.py. Its rows come to the driver: about a hundred by nature, and no
    more than max_templates."""

    def __init__(self, templates: DataFrame, config: Config = BALANCED, dictionary: DataFrame | None = None, max_templates: int = 5_000) -> None:
        if config.apply_dictionary_correction and dictionary is None:
            raise ValueError("the configuration asks for dictionary correction, so give a dictionary(idx, word)")
        self.config, self.dictionary = config, dictionary
        rows = [r.asDict(recursive=True) for r in templates.orderBy("def_idx").limit(max_templates + 1).collect()]
        if len(rows) > max_templates:
            raise ValueError(f"more than {max_templates} templates")
        self.templates = L.Templates.of(rows)

    @property
    def count(self) -> int:
        return len(self.templates.characters)

    template_width, template_height = K.TEMPLATE_COLS, K.TEMPLATE_ROWS

    def grids_of_images(self, images: DataFrame, contrast: float = 0.0) -> DataFrame:
        """(image_id, grid) from read_images(): binarised by each image's own threshold."""

        def binarize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                rows = []
                for r in p.itertuples():
                    raw = np.frombuffer(r.data, np.uint8).reshape(r.rows, r.cols, r.channels)
                    rgb = np.repeat(raw, 3, axis=2) if r.channels == 1 else raw[..., 2::-1]
                    rows.append((r.image_id, r.cols, r.rows, K.binarize(rgb, contrast).astype(np.uint8).tobytes()))
                yield pd.DataFrame(rows, columns=["image_id", "cols", "rows", "bits"])

        made = images.mapInPandas(binarize, "image_id string, cols int, rows int, bits binary")
        return made.select("image_id", F.struct("cols", "rows", "bits").alias("grid"))

    def layout(self, grids: DataFrame, id_col: str = "image_id") -> DataFrame:
        """(id, band_id, glyphs array): lines from top to bottom, spaces included, nothing recognised."""
        split, compat = self.config.attempt_character_splitting, self.config.compat

        def lay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                rows = [
                    (key, i, [_glyph_row(g) for g in band.glyphs])
                    for key, grid in zip(p[id_col], p["grid"], strict=True)
                    for i, band in enumerate(L.layout(_grid(grid), split, compat))
                ]
                yield pd.DataFrame(rows, columns=[id_col, "band_id", "glyphs"])

        kind = grids.schema[id_col].dataType.simpleString()
        return grids.select(id_col, "grid").mapInPandas(lay, f"`{id_col}` {kind}, band_id int, glyphs array<{GLYPH}>")

    def recognise(self, bands: DataFrame, id_col: str = "image_id", supported: str = "") -> DataFrame:
        """(id, band_id, line, glyphs) with characters and scores. Bands are independent."""
        templates, compat = self.templates, self.config.compat

        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                rows = []
                for key, i, glyphs in zip(p[id_col], p["band_id"], p["glyphs"], strict=True):
                    band = L.Band([_glyph(g) for g in glyphs])
                    line = L.recognise(band, templates, supported, compat)
                    rows.append((key, i, line, [_glyph_row(g) for g in band.glyphs]))
                yield pd.DataFrame(rows, columns=[id_col, "band_id", "line", "glyphs"])

        kind = bands.schema[id_col].dataType.simpleString()
        return bands.mapInPandas(read, f"`{id_col}` {kind}, band_id int, line string, glyphs array<{GLYPH}>")

    def clean(self, df: DataFrame, raw_col: str = "raw", out_col: str = "text") -> DataFrame:
        """Correction, clean-up and trimming of recognised text."""
        words = self.dictionary if self.config.apply_dictionary_correction else None
        done = apply_correction(df, raw_col, "__corrected", words, self.config.compat)
        return done.withColumn(out_col, F.trim(post_process(F.col("__corrected")))).drop("__corrected")

    def read_lines(self, grids: DataFrame, id_col: str = "image_id", supported: str = "") -> DataFrame:
        """(id, raw): layout and recognition of each image in one step; an image without ink has the empty text."""
        templates, split, compat = self.templates, self.config.attempt_character_splitting, self.config.compat

        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                raw = ["\n".join(L.recognise(b, templates, supported, compat) for b in L.layout(_grid(g), split, compat)) for g in p["grid"]]
                yield pd.DataFrame({id_col: p[id_col], "raw": raw})

        kind = grids.schema[id_col].dataType.simpleString()
        return grids.select(id_col, "grid").mapInPandas(read, f"`{id_col}` {kind}, raw string")

    def read_text(self, grids: DataFrame, id_col: str = "image_id", supported: str = "") -> DataFrame:
        """(id, text) of packed grids."""
        return self.clean(self.read_lines(grids, id_col, supported)).select(id_col, "text")

    def read_images(self, images: DataFrame, supported: str = "", contrast: float = 0.0) -> DataFrame:
        return self.read_text(self.grids_of_images(images, contrast), "image_id", supported)
