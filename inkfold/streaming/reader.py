"""Text of images that arrive in a folder: the batch plan, which keeps no state, over a stream. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.plans.engine import Engine


def stream_grids(spark: SparkSession, folder: str, max_files: int = 1_000) -> DataFrame:
    """A stream of packed grids from Parquet files of (image_id, grid)."""
    from inkfold.schema import GRID

    return spark.readStream.schema(f"image_id string, grid {GRID}").option("maxFilesPerTrigger", max_files).parquet(folder)


def stream_text(grids: DataFrame, engine: Engine) -> DataFrame:
    """(image_id, text), row by row. A dictionary joins by shuffle and isn't offered on streams."""
    if engine.config.apply_dictionary_correction:
        raise ValueError("use foreachBatch with Engine.read_text() for dictionary correction")
    return engine.read_text(grids)
