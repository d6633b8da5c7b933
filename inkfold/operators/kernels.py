"""Numpy kernels over one grid: a bool array of shape (rows, columns), True where there is ink.

They are what the Arrow operators of this package run on packed grids. Whatever a whole table of cells can say
is in grids.py as DataFrame operations; tests hold both forms against each other.
"""

from __future__ import annotations

import numpy as np

# Fixed values that results depend on.
LUMA = (0.299, 0.587, 0.114)
KERNEL_RATIO = 0.02
MAX_SPECK, LINE_LOW, LINE_HIGH = 2, 0.09, 50.0
PUNCTUATION_HEIGHT = 0.40
HOLE_SIZE, HOLE_SHARE = 3, 0.01
LINE_SHARE, STEM_SHARE = 0.7, 0.8
STROKE_X, STROKE_Y, STROKE_DENSITY = 0.55, 0.55, 0.6
VALLEY_FACTOR, VALLEY_WINDOW, VALLEY_DEPTH, SPLIT_GAP = 1.2, 2, 0.4, 2
DENSITY = (0.2, 0.5)
FILL = (0.25, 0.45)
DEFAULT_FILL, ERODE_NEIGHBOURS = 0.3, 5
TEMPLATE_COLS, TEMPLATE_ROWS = 40, 60


def half_up(v: float) -> int:
    """Rounds halves away from zero."""
    return int(np.floor(v + 0.5)) if v >= 0 else -int(np.floor(-v + 0.5))


# ------------------------------------------------------------------ pixels


def gray(rgb: np.ndarray, contrast: float = 0.0) -> np.ndarray:
    """0..255 from (rows, columns, 3); contrast stretches around 128."""
    g = np.floor(LUMA[0] * rgb[..., 0] + LUMA[1] * rgb[..., 1] + LUMA[2] * rgb[..., 2])
    factor = 259 * (contrast + 255) / (255 * (259 - contrast))
    return np.floor(np.clip(factor * (g - 128) + 128, 0, 255)).astype(np.int64)


def otsu(levels: np.ndarray) -> int:
    """The first threshold of the greatest variance between both classes; 128 if there is no split."""
    counts = np.bincount(levels.reshape(-1), minlength=256).astype(np.float64)
    below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 128
    spread = np.zeros(256)
    spread[ok] = below[ok] * above[ok] * (sums[ok] / below[ok] - (sums[-1] - sums[ok]) / above[ok]) ** 2
    return int(spread.argmax()) if spread.max() > 0 else 128


def binarize(rgb: np.ndarray, contrast: float = 0.0) -> np.ndarray:
    """Ink is what isn't brighter than Otsu's threshold."""
    g = gray(rgb, contrast)
    return ~(g > otsu(g))


def kernel_size(cols: int, ratio: float = KERNEL_RATIO) -> int:
    return max(1, min(cols, half_up(ratio * cols)))


def _box_sum(grid: np.ndarray, half: int) -> np.ndarray:
    """Ink in the square of 2 * half + 1 around each cell, clipped at the borders."""
    total = np.pad(grid.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    rows, cols = grid.shape
    y0, y1 = np.maximum(np.arange(rows) - half, 0), np.minimum(np.arange(rows) + half + 1, rows)
    x0, x1 = np.maximum(np.arange(cols) - half, 0), np.minimum(np.arange(cols) + half + 1, cols)
    return total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]


def dilate(grid: np.ndarray, size: int) -> np.ndarray:
    return _box_sum(grid, size // 2) > 0


def erode_soft(grid: np.ndarray) -> np.ndarray:
    """Ink with at least five inked cells in its 3 x 3, itself included."""
    return grid & (_box_sum(grid, 1) >= ERODE_NEIGHBOURS)


# ------------------------------------------------------------------ boxes


def content(grid: np.ndarray) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of the ink; zeros if there is none."""
    ys, xs = np.flatnonzero(grid.any(axis=1)), np.flatnonzero(grid.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else (0, 0, 0, 0)


def trim(grid: np.ndarray) -> np.ndarray:
    l, t, r, b = content(grid)
    return grid[t:b, l:r]


def wrap(grid: np.ndarray) -> np.ndarray:
    return np.pad(grid, 1)


def pad(grid: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """More empty rows; negative counts take rows away."""
    out = np.pad(grid, ((max(0, top), max(0, bottom)), (0, 0)))
    return out[max(0, -top) : len(out) - max(0, -bottom)]


def crop(grid: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """What lies outside of the grid is empty."""
    out = np.zeros((height, width), bool)
    y0, y1, x0, x1 = max(0, top), min(grid.shape[0], top + height), max(0, left), min(grid.shape[1], left + width)
    if y0 < y1 and x0 < x1:
        out[y0 - top : y1 - top, x0 - left : x1 - left] = grid[y0:y1, x0:x1]
    return out


def is_line(grid: np.ndarray) -> bool:
    l, t, r, b = content(grid)
    return r > l and not LINE_LOW <= (b - t) / (r - l) <= LINE_HIGH


def is_speck(grid: np.ndarray) -> bool:
    return grid.size <= MAX_SPECK or is_line(grid)


def is_punctuation(grid: np.ndarray) -> bool:
    l, t, r, b = content(grid)
    return r > l and b - t < len(grid) * PUNCTUATION_HEIGHT


def fill_threshold(density: float) -> float:
    t = (density - DENSITY[0]) / (DENSITY[1] - DENSITY[0])
    return FILL[0] if density <= DENSITY[0] else FILL[1] if density >= DENSITY[1] else FILL[0] + (FILL[1] - FILL[0]) * t


def resize(grid: np.ndarray, cols: int, rows: int, fill: float = DEFAULT_FILL) -> np.ndarray:
    """Nearest cell if either side grows, else ink where the share of the covered cells reaches fill."""
    high, wide = grid.shape
    if not high or not wide:
        return np.zeros((rows, cols), bool)
    sx, sy = wide / cols, high / rows
    x, y = np.arange(cols) * sx, np.arange(rows) * sy
    if cols > wide or rows > high:
        return grid[np.floor(y).astype(int)][:, np.floor(x).astype(int)]
    total = np.pad(grid.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    x0, x1 = np.floor(x).astype(int), np.minimum(np.ceil(x + sx).astype(int), wide)
    y0, y1 = np.floor(y).astype(int), np.minimum(np.ceil(y + sy).astype(int), high)
    ink = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return ink / np.maximum(1, np.outer(y1 - y0, x1 - x0)) >= fill


def normalise(grid: np.ndarray, cols: int = TEMPLATE_COLS, rows: int = TEMPLATE_ROWS) -> np.ndarray:
    """To a template's size; all but punctuation is trimmed first."""
    w = wrap(grid if is_punctuation(grid) else trim(grid))
    return resize(w, cols, rows, fill_threshold(w.sum() / w.size))


# ------------------------------------------------------------------ components


def labels(grid: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each inked cell the raster index of its component's first cell; -1 elsewhere."""
    rows, cols = grid.shape
    cell = np.arange(rows * cols).reshape(rows, cols)
    steps = [(grid[:, :-1] & grid[:, 1:], cell[:, :-1], cell[:, 1:]), (grid[:-1] & grid[1:], cell[:-1], cell[1:])]
    if diagonal:
        steps += [
            (grid[:-1, :-1] & grid[1:, 1:], cell[:-1, :-1], cell[1:, 1:]), (grid[:-1, 1:] & grid[1:, :-1], cell[:-1, 1:], cell[1:, :-1]),
        ]
    a, b = (np.concatenate([s[k][s[0]] for s in steps]) for k in (1, 2))
    root = np.arange(rows * cols)
    while len(a):
        # Hook the larger root of every edge to the smaller, then halve all paths.
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return np.where(grid, root.reshape(rows, cols), -1)


def boxes(label: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(first cell, left, top, right, bottom) of each component, by first cell."""
    ys, xs = np.nonzero(label >= 0)
    if not len(ys):
        return []
    names, which = np.unique(label[ys, xs], return_inverse=True)
    n = len(names)
    l, t, r, b = np.full(n, label.shape[1]), np.full(n, label.shape[0]), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(l, which, xs)
    np.minimum.at(t, which, ys)
    np.maximum.at(r, which, xs + 1)
    np.maximum.at(b, which, ys + 1)
    return list(zip(names.tolist(), l.tolist(), t.tolist(), r.tolist(), b.tolist(), strict=True))


def flood(grid: np.ndarray, x: int, y: int, diagonal: bool = True) -> list[tuple[int, int]]:
    """(x, y) of the component that holds a cell, by row and column; none if it isn't inked or lies outside."""
    if not (0 <= y < grid.shape[0] and 0 <= x < grid.shape[1]) or not grid[y, x]:
        return []
    label = labels(grid, diagonal)
    ys, xs = np.nonzero(label == label[y, x])
    return list(zip(xs.tolist(), ys.tolist(), strict=True))


def _dense(v: np.ndarray) -> np.ndarray:
    """Places from 1 on; numbers that are one apart stay so, larger gaps become 2."""
    names, at = np.unique(v, return_inverse=True)
    return np.cumsum(np.minimum(np.diff(names, prepend=names[:1]), 2))[at] + 1


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n vertices, the least index reachable over the edges a - b: roots hook to the least that an edge shows, until none differ."""
    root = np.arange(n)
    while len(a):
        least, most = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = least != most
        a, b = a[apart], b[apart]
        np.minimum.at(root, most[apart], least[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def cell_components(grid: np.ndarray, x: np.ndarray, y: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of cells of many grids, which are numbers: indexes of the distinct cells by grid, row and column, and for
    each of them the index of its component's first cell."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    across, down = _dense(x), _dense(y)
    wide, high = int(across.max()) + 2, int(down.max()) + 2
    key, order = np.unique((grid.astype(np.int64) * high + down) * wide + across, return_index=True)
    i, j = [], []
    for step in (1, wide, *((wide - 1, wide + 1) if diagonal else ())):
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        met = np.flatnonzero(key[at] == key + step)
        i.append(met)
        j.append(at[met])
    return order, order[roots(len(key), np.concatenate(i), np.concatenate(j))]


def many_enclosures(cols: np.ndarray, rows: np.ndarray, grid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """enclosures() of many grids at once: sizes by grid, and inked cells of which those outside of their grid don't count."""
    area = np.where((cols > 0) & (rows > 0), cols * rows, 0)
    start = np.cumsum(area) - area
    inside = (x >= 0) & (y >= 0) & (x < cols[grid]) & (y < rows[grid])
    grid, x, y = grid[inside], x[inside], y[inside]
    back = np.ones(int(area.sum()), bool)
    back[start[grid] + y * cols[grid] + x] = False
    at = np.flatnonzero(back)
    of = np.repeat(np.arange(len(area)), area)[at]
    y, x = np.divmod(at - start[of], np.maximum(cols[of], 1))
    order, first = cell_components(of, x, y, False)
    n = np.bincount(first, minlength=len(at))
    edge = (x == 0) | (y == 0) | (x == cols[of] - 1) | (y == rows[of] - 1)
    border = np.zeros(len(at), bool)
    border[first[edge[order]]] = True
    hole = (n >= HOLE_SIZE) & (n / area[of] >= HOLE_SHARE) & ~border
    return np.bincount(of[hole], minlength=len(area))


def enclosures(grid: np.ndarray) -> int:
    """Holes: background regions (4 neighbours) off the border, not too small in cells and in share."""
    if not grid.size:
        return 0
    label = labels(~grid, False)
    edge = np.unique(np.concatenate((label[0], label[-1], label[:, 0], label[:, -1])))
    names, sizes = np.unique(label[label >= 0], return_counts=True)
    return int(((sizes >= HOLE_SIZE) & (sizes / grid.size >= HOLE_SHARE) & ~np.isin(names, edge)).sum())


def vertical_line(grid: np.ndarray, side: str) -> bool:
    """Whether some column has a long run of ink with nothing inked beside it on that side."""
    rows = len(grid)
    if not grid.any():
        return False
    need = int(rows * LINE_SHARE)
    beside = np.zeros_like(grid)
    if side == "left":
        beside[:, 1:] = grid[:, :-1]
    else:
        beside[:, :-1] = grid[:, 1:]
    run = np.zeros(grid.shape[1], int)
    for row in grid & ~beside:
        run = np.where(row, run + 1, 0)
        if need and (run >= need).any():
            return True
    return need == 0


def stems(grid: np.ndarray) -> int:
    column = trim(grid).sum(axis=0)
    if not column.size:
        return 0
    tall = column >= max(1, half_up(column.max() * STEM_SHARE))
    return int(tall[0]) + int((tall[1:] & ~tall[:-1]).sum())


def lower_right_stroke(grid: np.ndarray) -> bool:
    ink = trim(grid)
    if not ink.size:
        return False
    part = ink[min(len(ink), half_up(len(ink) * STROKE_Y)) :, min(ink.shape[1], half_up(ink.shape[1] * STROKE_X)) :]
    return bool(part.size) and part.mean() >= ink.mean() * STROKE_DENSITY


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Cells inked in both by cells inked in either; 0 for two empty grids or unequal sizes (T2)."""
    if a.shape != b.shape:
        return 0.0
    either = int((a | b).sum())
    return int((a & b).sum()) / either if either else 0.0


# ------------------------------------------------------------------ profiles and splits


def _flats(h: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(h)) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(np.arange(len(h)), cuts) if len(p)]


def valley_threshold(h: np.ndarray) -> int:
    """1.2 times the lowest inner run that is lower than both its neighbours, cut to an integer; -1 without one."""
    h = np.asarray(h)
    if len(h) < 3:
        return -1
    low = [int(h[s]) for s, e in _flats(h) if s > 0 and e < len(h) - 1 and h[s] < h[s - 1] and h[s] < h[e + 1]]
    return int(min(low) * VALLEY_FACTOR) if low else -1


def soft_valleys(h: np.ndarray) -> list[int]:
    """Middles of level runs, off the borders, that are no higher than what is before them (a run of one: and behind it) and at
    most VALLEY_DEPTH of the lower of the peaks VALLEY_WINDOW columns to each side."""
    h = np.asarray(h, dtype=np.int64)
    runs = np.array(_flats(h)).reshape(-1, 2)[1:-1]
    if not len(runs):
        return []
    # around[i] has the VALLEY_WINDOW columns before column i; beyond the borders there is nothing.
    around = np.lib.stride_tricks.sliding_window_view(np.pad(h, VALLEY_WINDOW), VALLEY_WINDOW)
    first, last = runs.T
    peak = np.minimum(around[first].max(axis=1), around[last + 1 + VALLEY_WINDOW].max(axis=1))
    low = (h[first] <= h[first - 1]) & ((last > first) | (h[first] <= h[last + 1])) & (peak > 0) & (h[first] <= np.floor(peak * VALLEY_DEPTH + 0.5))
    return ((first + last) // 2)[low].tolist()


def split_offsets(grid: np.ndarray, soft: bool = True) -> list[int]:
    """Columns at which a wide glyph may be cut."""
    h = grid.sum(axis=0)
    if not len(h) or (h == h[0]).all():
        return []
    limit = valley_threshold(h)
    low = np.concatenate(([False], h <= limit, [False])) if limit >= 0 else np.zeros(len(h) + 2, bool)
    edges = np.flatnonzero(low[1:] != low[:-1])
    gaps = [(int(a), int(b) - 1) for a, b in zip(edges[0::2], edges[1::2], strict=True)]
    gaps += [(v, v) for v in (soft_valleys(h) if soft else [])]
    found = sorted(a + (b - a + 1) // 2 for a, b in gaps if a > 0 and b < len(h) - 1)
    out: list[int] = []
    for f in found:
        if not out or f - out[-1] >= SPLIT_GAP:
            out.append(f)
    return out


def split_columns(grid: np.ndarray, offsets: list[int]) -> list[tuple[int, np.ndarray]]:
    """(first column, part) between the offsets."""
    cuts = [0, *offsets, grid.shape[1]]
    return [(a, grid[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a] if offsets else []
