import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.operators import kernels as K
from inkfold.operators import layout_kernels as L


def g(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def show(grid):
    return ["".join("#" if c else "." for c in r) for r in grid]


def test_normalise_goldens():
    assert show(K.normalise(g("##..", ".##.", "..##"), 6, 5)) == ["......", ".##...", "..##..", "...##.", "......"]
    assert show(K.normalise(g("##..", ".##.", "..##"), 2, 2)) == ["#.", ".#"]
    assert show(K.normalise(g(".#.", "###", ".#."), 5, 5)) == [".....", "..#..", ".###.", "..#..", "....."]


@pytest.mark.parametrize(
    "h, expected",
    [([], -1), ([1, 2], -1), ([1, 2, 3, 4, 5], -1), ([5, 2, 6, 1, 7], 1), ([8, 3, 7, 2, 9, 1, 6], 1), ([5, 2, 7, 1, 6], 1), ([5, 2, 7, 3, 9, 1, 8], 1)],
)
def test_valley_threshold(h, expected):
    assert K.valley_threshold(h) == expected


def test_trim_pad_merge():
    assert K.trim(np.zeros((5, 5), bool)).size == 0
    assert show(K.trim(g(".....", "..#..", "....."))) == ["#"]
    assert show(K.pad(g("#.#", ".#."), 0, 2)) == ["#.#", ".#.", "...", "..."]
    assert show(K.pad(g("#.#", ".#."), 2, 0)) == ["...", "...", "#.#", ".#."]
    assert len(K.pad(g("#"), 100, 100)) == 201
    a = L.Glyph(g("#..", "..#", "#.."))
    a.merge(L.Glyph(g("..#", "#..", "..#")))
    assert show(a.grid) == ["#.#", "#.#", "#.#"]


def test_trap_t8_a_merge_keeps_its_origin_unless_repaired():
    for compat, x in ((True, 5), (False, 2)):
        a = L.Glyph(g("#"), 5, 5)
        a.merge(L.Glyph(g("#"), 2, 5), compat)
        assert (a.x, a.cols) == (x, 4)


def test_flood_and_profiles():
    grid = g("..#..", "..#..", ".....", ".##..", ".##..")
    assert len(K.flood(grid, 2, 0)) == 2 and len(K.flood(grid, 1, 3)) == 4
    assert K.flood(grid, -1, 0) == [] and K.flood(grid, 0, 0) == []
    assert np.eye(3, dtype=bool).sum(axis=0).tolist() == [1, 1, 1]


def test_features():
    assert K.enclosures(g(".......", ".#####.", ".#...#.", ".#...#.", ".#####.", ".......")) == 1
    assert K.vertical_line(g("#"), "left") and K.vertical_line(g("#"), "right")  # T: one row asks for no length
    assert K.vertical_line(g("#.", "#.", "##"), "left") and not K.vertical_line(g("##", ".#", "#."), "left")
    assert not K.is_line(np.zeros((4, 4), bool)) and K.is_line(np.ones((1, 20), bool))
    assert K.overlap(np.zeros((2, 2), bool), np.zeros((2, 2), bool)) == 0.0  # T2
    assert K.kernel_size(10) == 1 and K.kernel_size(75) == 2 and K.kernel_size(200) == 4  # T11
    assert K.otsu(np.full(9, 255)) == 128  # T20
    assert K.wrap(np.zeros((0, 0), bool)).shape == (2, 2)  # T19
    assert K.half_up(2.5) == 3 and K.half_up(-2.5) == -3  # T24


def test_split_chunk():
    grid = g("##..##", "##..##", "##..##", "######")
    assert [show(p) for _, p in K.split_columns(grid, K.split_offsets(grid, soft=False))] == [["##.", "##.", "##.", "###"], [".##", ".##", ".##", "###"]]
    assert K.split_columns(g("####"), K.split_offsets(g("####"))) == []


def test_band_descriptions_and_joining():
    two = [L.Glyph(np.zeros((2, 3), bool), x, 10, x, 10) for x in (10, 14)]
    assert L.Band().describe() == "[0] Avg(W:0, H:0 G:-1)"
    assert L.Band([L.Glyph(np.zeros((16, 8), bool), character=" ")]).describe() == "[1] Avg(W:8, H:16 G:-1) S[1]"
    joined = L.join_bands([L.Band([two[0]]), L.Band([two[1]])])
    assert len(joined) == 1 and joined[0].describe() == "[2] Avg(W:2, H:2 G:1)"  # T7
    far = [L.Band([L.Glyph(np.ones((20, 20), bool), x, 10, x, 10)]) for x in (10, 500)]
    assert len(L.join_bands(far)) == 2


def test_wide_chunks_and_overlap_merge():
    def band(*at):
        return L.Band([L.Glyph(np.ones((5, w), bool), x, 0, x, 0) for x, w in at])

    assert band((0, 10), (20, 10)).wide() == []
    assert [w.cols for w in band((0, 10), (15, 50)).wide()] == [50]
    a, b, c = L.Glyph(g("#..", "..#", "#..")), L.Glyph(g("..#", "#..", "..#")), L.Glyph(g("..", ".#"))
    assert len(L.merge_overlaps([a, b, c])) == 1
    b = L.Glyph(g("..#", "#..", "..#"), 30, 30)
    assert len(L.merge_overlaps([L.Glyph(g("#..", "..#", "#..")), b])) == 2


def test_trap_t4_wide_glyph_without_a_valley():
    solid = np.zeros((12, 120), bool)
    for x, w in ((2, 8), (14, 8), (26, 8), (40, 60)):
        solid[2:10, x : x + w] = True
    assert sum(len(b.glyphs) for b in L.layout(solid, compat=True)) < sum(len(b.glyphs) for b in L.layout(solid, compat=False))


def test_empty_image():
    assert L.layout(np.zeros((1, 1), bool)) == [] and L.layout(np.zeros((0, 0), bool)) == []


grids = st.integers(1, 9).flatmap(lambda w: st.lists(st.lists(st.booleans(), min_size=w, max_size=w), min_size=1, max_size=9)).map(lambda r: np.array(r, bool))


@settings(max_examples=60, deadline=None)
@given(grids, st.booleans())
def test_components_equal_breadth_first(grid, diagonal):
    label, seen = K.labels(grid, diagonal), {}
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + [(a, b) for a in (1, -1) for b in (1, -1)] * diagonal
    for y, x in zip(*np.nonzero(grid), strict=True):
        if (y, x) in seen:
            continue
        queue, seen[y, x] = [(y, x)], (y, x)
        while queue:
            cy, cx = queue.pop()
            for dy, dx in steps:
                n = (cy + dy, cx + dx)
                if 0 <= n[0] < grid.shape[0] and 0 <= n[1] < grid.shape[1] and grid[n] and n not in seen:
                    seen[n] = (y, x)
                    queue.append(n)
    for (y, x), (fy, fx) in seen.items():
        assert label[y, x] == fy * grid.shape[1] + fx
    assert (label >= 0).sum() == len(seen)


@settings(max_examples=60, deadline=None)
@given(grids)
def test_dilate_and_erode_by_definition(grid):
    rows, cols = grid.shape
    for y in range(rows):
        for x in range(cols):
            near = grid[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            assert K.dilate(grid, 3)[y, x] == near.any()
            assert K.erode_soft(grid)[y, x] == (grid[y, x] and near.sum() >= 5)
