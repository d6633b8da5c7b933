import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import grids as G
from inkfold.operators import kernels as K
from inkfold.operators import layout_kernels as L
from inkfold.operators.correction import CONFUSIONS, correct_tokens, nearest_words
from inkfold.plans import shared
from inkfold.sources import png
from inkfold.sources.templates import DIGITS, LOWER, OTHERS, PUNCTUATION, SUPPORTED, UPPER


def g(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def _jvm_png(spark, rgb, kind):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(rgb.shape[1], rgb.shape[0], kind)
    for y in range(rgb.shape[0]):
        for x in range(rgb.shape[1]):
            image.setRGB(x, y, -1 << 24 | int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "png", out)
    return bytes(out.toByteArray())


def test_png_of_another_writer(spark):
    rng = np.random.default_rng(0)
    smooth = np.add.outer(np.arange(13) * 5, np.arange(17) * 3)[..., None] + np.array([0, 40, 90])
    for rgb in (rng.integers(0, 256, (13, 17, 3)), smooth % 256):
        for kind in (1, 2, 5):  # RGB, ARGB, BGR
            assert (png.read_png(_jvm_png(spark, rgb, kind)) == rgb).all()
    black_or_white = np.repeat(rng.integers(0, 2, (9, 21, 1)) * 255, 3, axis=2)
    for kind in (10, 12, 13):  # gray, one bit, palette
        got = png.read_png(_jvm_png(spark, black_or_white, kind))
        assert (np.repeat(got, 3, axis=2)[..., :3] == black_or_white).all()


def test_image_columns(spark):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    data = [(1, bytearray(png.write_png(rgb))), (2, None), (3, bytearray(b"junk")), (4, bytearray(png.write_png(rgb)[:60])), (5, bytearray(png.write_png(rgb[..., 0])))]
    df = spark.createDataFrame(data, "k long, media binary")
    got = {r.image_id: r for r in png.decode_images(df, "k", "media", broken_to_null=True).collect()}
    assert (got["1"].cols, got["1"].rows, got["1"].channels, bytes(got["1"].data)) == (7, 5, 3, rgb[..., ::-1].tobytes())
    assert got["5"].channels == 1 and got["2"].data is None and got["3"].data is None and got["4"].data is None
    with pytest.raises(Exception, match="PNG"):
        png.decode_images(df.where("k = 3"), "k", "media").collect()
    assert png.decode_images(df.limit(0), "k", "media").collect() == []
    grid = spark.createDataFrame([(2, 1, bytearray(b"\1\0")), (0, 0, bytearray())], "cols int, rows int, bits binary").select(F.struct("*").alias("grid"))
    made = [r.p for r in grid.select(png.encode_images(F.col("grid")).alias("p")).collect()]
    assert png.read_png(bytes(made[0]))[..., 0].tolist() == [[0, 255]] and made[1] is None


def test_shape_tests_equal_kernels(spark):
    rng = np.random.default_rng(2)
    made = [np.zeros((4, 4), bool), g("#"), g("##"), g("############"), g(*(["......"] * 9 + ["#....."])), *[rng.random((rng.integers(1, 9), rng.integers(1, 14))) < 0.1 for _ in range(60)]]
    cells = [(i, int(x), int(y)) for i, m in enumerate(made) for y, x in zip(*np.nonzero(m), strict=True)]
    sizes = spark.createDataFrame([(i, m.shape[1], m.shape[0]) for i, m in enumerate(made)], "grid_id int, cols int, rows int")
    table = spark.createDataFrame(cells, "grid_id int, x int, y int")
    for r in G.shape_tests(table, sizes).collect():
        m = made[r.grid_id]
        assert (r.is_empty, r.is_line, r.is_speck, r.is_punctuation) == (not m.any(), K.is_line(m), K.is_speck(m), K.is_punctuation(m))
    marks = spark.createDataFrame([(1, 0, 0, False), (2, 5, 0, True), (2, 0, 0, True), (3, 2, 0, False), (3, 2, 0, True)], "grid_id int, x int, y int, on boolean")
    after = {(r.grid_id, r.x, r.y) for r in G.set_cells(table, sizes, marks).collect()}
    assert after == {c for c in cells if c != (1, 0, 0)}
    assert G.clear(table).count() == 0 and {(r.x, r.y) for r in G.translate(table.where("grid_id = 1"), 3, -2).collect()} == {(3, -2)}


def test_soft_valleys_by_definition(spark):
    rng = np.random.default_rng(3)
    many = [rng.integers(0, 9, rng.integers(0, 25)) for _ in range(120)]

    def brute(h):
        out, n = [], len(h)
        for a in range(1, n - 1):
            b = a
            while b + 1 < n and h[b + 1] == h[a]:
                b += 1
            if h[a - 1] == h[a] or b == n - 1 or h[a - 1] < h[a] or (a == b and h[b + 1] < h[a]):
                continue
            peak = min(max(h[max(0, a - 2) : a]), max(h[b + 1 : b + 3]))
            if peak and h[a] <= int(peak * 0.4 + 0.5):
                out.append((a + b) // 2)
        return out

    bins = spark.createDataFrame([(i, x, int(n)) for i, h in enumerate(many) for x, n in enumerate(h)], "k int, x int, n int")
    table: dict = {}
    for r in G.soft_valleys(bins, "k").collect():
        table.setdefault(r.k, []).append(r.valley)
    for i, h in enumerate(many):
        assert K.soft_valleys(h) == brute(h.tolist()) == sorted(table.get(i, []))


def test_nearest_words_by_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, last = [i], row
            for j, d in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    rng = np.random.default_rng(4)
    known = sorted({"".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(60)} | {"k" * 19, "m" * 30, "n" * 199, "éè"})
    asked = ["".join(rng.choice(list("abcde"), rng.integers(0, 11))) for _ in range(80)] + ["K" * 18, "k" * 21, "m" * 28, "n" * 201, "zzzzzzzzzzzz", "", None, "ABCD", "é"]
    dictionary = spark.createDataFrame(list(enumerate(known)), "idx int, word string")
    got = {r.word: (r.nearest, r.distance) for r in nearest_words(spark.createDataFrame([(w,) for w in asked], "word string"), dictionary).collect()}
    assert set(got) == {w for w in asked if w is not None}
    for w, found in got.items():
        best = min((distance(w.lower(), k.lower()), -len(k), i, k) for i, k in enumerate(known))
        assert found == (best[3], best[0])
    assert nearest_words(dictionary, dictionary.limit(0)).collect() == []


def test_files_of_shared_tables_go(spark):
    import os

    made = shared.materialise(spark.range(3))
    path = made._inkfold_path.removeprefix("file:")
    assert os.path.isdir(path)
    shared.release(made)
    assert not os.path.isdir(path)


def test_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_SHARE", 5)
    rows = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(100)], "k int, v int")
    labels = shared.materialise(rows.where("k <> 4").groupBy("k").agg(F.count("*").alias("copies")).withColumn("name", F.col("k") * 10))
    for limit in (1000, 3):
        got = {(r.k, r.v, r.name) for r in shared.label_join(rows, labels, ["k"], limit=limit).collect()}
        assert got == {(r.k, r.v, None if r.k == 4 else r.k * 10) for r in rows.collect()}


# ------------------------------------------------------------------ traps


def test_trap_t5_an_emptied_band_disappears():
    band = L.Band([L.Glyph(g("####", "####"))])
    band.substitute(band.glyphs[0], [])
    band.pack()
    assert band.glyphs == []


def test_trap_t6_near_glyphs_that_do_not_overlap_stay_apart():
    assert len(L.merge_overlaps([L.Glyph(g("#", "#"), 0, 0), L.Glyph(g("#", "#"), 1, 0)])) == 2


def test_trap_t9_regions_have_four_neighbours_and_glyphs_eight():
    diagonal = g("#..", ".#.", "..#")
    assert len(K.boxes(K.labels(diagonal, False))) == 3 and len(L.glyphs_of(diagonal)) == 1
    assert K.enclosures(g("####", "#..#", "#..#", "####")) == 1 and K.enclosures(g("####", "#..#", "#.##", "##..")) == 1


def test_trap_t10_ties_of_the_order_keep_their_places():
    items = [(5, 8), (1, 4), (3, 0)]
    assert L.reading_order(items, lambda i: i, 5) in ([(1, 4), (5, 8), (3, 0)], [(3, 0), (1, 4), (5, 8)], [(1, 4), (3, 0), (5, 8)])
    assert L.reading_order([(2, 0, "a"), (2, 3, "b")], lambda i: i[:2], 5) == [(2, 0, "a"), (2, 3, "b")]


def test_trap_t15_a_lone_exclamation_mark_is_never_corrected(spark):
    assert "!" in dict(CONFUSIONS)
    words = spark.createDataFrame([(0, "I"), (1, "tin")], "idx int, word string")
    assert correct_tokens(spark.createDataFrame([("!",), ("?",)], "token string"), words).collect() == []


def test_trap_t21_supported_characters():
    assert (len(UPPER + LOWER), len(DIGITS), len(PUNCTUATION), len(OTHERS), len(SUPPORTED)) == (52, 10, 18, 9, 89) and len(set(SUPPORTED)) == 89


def test_trap_t22_a_region_is_a_box():
    # The ink of the inner region lies in the outer one's box too.
    outer = np.zeros((30, 60), bool)
    outer[0, :] = outer[-1, :] = outer[:, 0] = outer[:, -1] = True
    outer[14:16, 28:32] = True
    boxes = L.regions(outer)
    assert len(boxes) == 2 and any(K.crop(outer, l, t, r - l, b - t)[14:16, 28:32].all() for l, t, r, b in boxes if r - l > 40)


def test_trap_t23_moving_changes_where_a_glyph_was_found():
    glyph = L.glyphs_of(g("...", ".#."), 10, 20)[0]
    assert (glyph.x, glyph.y, glyph.ax, glyph.ay) == (11, 21, 1, 1)


def test_trap_t25_profiles_are_named_by_what_they_count_along(spark):
    cells = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "grid_id int, x int, y int")
    sizes = spark.createDataFrame([(0, 2, 3)], "grid_id int, cols int, rows int")
    assert [r.n for r in G.profile(cells, sizes, "x").orderBy("x").collect()] == [2, 0]
    assert [r.n for r in G.profile(cells, sizes, "y").orderBy("y").collect()] == [1, 1, 0]


def test_trap_t26_flags_that_nothing_reads():
    row = {"character": "A", "enclosures": 1, "isPunctuation": False, "lineLeft": False, "lineRight": False, "matrices": [{"data": ["#" * 40] * 60}]}
    told = L.Templates.of([row | {"isAmount": True, "isDate": True, "isDigit": True, "isLetter": False}])
    plain = L.Templates.of([row])
    assert told.characters == plain.characters and (told.features == plain.features).all() and (told.bits == plain.bits).all()
