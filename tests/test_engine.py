import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.config import ACCURATE, ROBUST
from inkfold.operators import evaluate
from inkfold.plans.engine import Engine
from inkfold.sources import grids as S
from inkfold.sources.render import draw_text, rendered, stroke_templates
from inkfold.streaming.reader import stream_grids, stream_text

CASES = ["ABCDEFGHIJKLM", "NOPQRSTUVWXYZ", "abcdefghijklm", "nopqrstuvwxyz", "0123456789", "The quick brown fox", "Hello World 123", ""]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(stroke_templates(spark).cache())


@pytest.fixture(scope="module")
def images(spark):
    return rendered(spark.createDataFrame(list(enumerate(CASES)), "image_id long, text string"), "image_id", "text", 28)


def test_accuracy_beats_the_published_level(spark, engine, images):
    read = engine.read_text(images).withColumnRenamed("text", "actual")
    cases = evaluate.per_case(read.join(images.select("image_id", "expected"), "image_id"))
    assert evaluate.overall(cases).first().accuracy > 0.9
    assert cases.where("expected = ''").first().actual == ""


def test_supported_characters_restrict(engine, images):
    lines = engine.read_lines(images.where("image_id = 4"), supported="0123456789").first().raw
    assert set(lines) <= set("0123456789 ")


def test_staged_equals_whole(engine, images):
    staged = engine.recognise(engine.layout(images)).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band_id", "line"))), lambda b: b["line"]), "\n").alias("raw"))
    whole = {r.image_id: r.raw for r in engine.read_lines(images).collect() if r.raw}
    assert {r.image_id: r.raw for r in staged.collect()} == whole


def test_images_from_files(spark, engine, tmp_path):
    grid = draw_text("Hello 42", 28)
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(grid.shape[1], grid.shape[0], 1)
    for y in range(grid.shape[0]):
        for x in range(grid.shape[1]):
            image.setRGB(x, y, 0x101010 if grid[y, x] else 0xF0F0F0)
    jvm.javax.imageio.ImageIO.write(image, "png", jvm.java.io.File(str(tmp_path / "a.png")))
    read = S.read_images(spark, str(tmp_path))
    assert engine.read_images(read).first().text == "Hello 42"
    pixels = S.pixels_of(read.limit(1)).where("x < 40 and y < 30")
    assert pixels.where("r = 16").count() == int(grid[:30, :40].sum())


def test_stream_equals_batch(spark, engine, images, tmp_path):
    some = images.where("image_id in (4, 6)").select(F.col("image_id").cast("string").alias("image_id"), "grid")
    some.write.parquet(str(tmp_path / "in"))
    query = stream_text(stream_grids(spark, str(tmp_path / "in")), engine).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.image_id: r.text for r in spark.table("texts").collect()} == {r.image_id: r.text for r in engine.read_text(some).collect()}


def test_empty_grid(spark, engine):
    one = spark.createDataFrame([("e", (1, 1, bytearray(b"\0")))], "image_id string, grid struct<cols:int,rows:int,bits:binary>")
    assert engine.read_text(one).first().text == ""
    assert np.zeros((1, 1)).sum() == 0


@pytest.mark.parametrize("config", [ACCURATE, ROBUST])
def test_a_preset_with_a_dictionary_needs_one(config):
    with pytest.raises(ValueError, match="dictionary"):
        Engine(None, config)
