"""Layout and recognition of one image: order-dependent merges and splits, which no set operation expresses.

An image's regions become lines ("bands") of glyphs; bands are joined, spaces found, and each glyph is
matched with the templates. compat=True keeps the quirks T4 (a wide glyph without a valley is lost) and T8 (a merge
doesn't move its origin); compat=False repairs them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, cmp_to_key

import numpy as np

from inkfold.operators import kernels as K

# Fixed values that results depend on.
KERNING, SAME_WIDTH, WIDE, WIDE_FEW, SOFT_FROM = 4, (0.7, 1.3), 2.0, 1.5, 2.0
ATTACH_AREA, ATTACH_DISTANCE, ATTACH_HEIGHT, ATTACH_WIDTH, KEEP_HEIGHT = 0.25, 0.25, 0.6, 0.8, 0.6
BORDER, MIN_SPACE, MEDIAN_FACTOR, WIDTH_FACTOR, JUMP = 2, 2, 1.6, 0.4, 1.8
OVERLAP, ROW_RATIO, JOIN_RATIO, ROW_TOLERANCE = 0.8, 0.4, 1.2, 5.0
SPLIT_BELOW, R_GAP, MU_ASPECT, MU_GAP, MU_STEMS = 0.4, 0.06, 1.05, 0.08, 2
MERGE_SCORE, MERGE_GAIN, NARROW, MERGE_WIDTH, H_GAP = 0.6, 0.05, 0.6, 1.3, 0.08
BEST, AVERAGE, QUORUM = 0.7, 0.3, 2


@dataclass
class Glyph:
    grid: np.ndarray
    x: int = 0
    y: int = 0
    ax: int = 0
    ay: int = 0
    character: str = ""
    score: float = 0.0
    inspect: bool = False
    was_split: bool = False

    @property
    def cols(self) -> int:
        return self.grid.shape[1]

    @property
    def rows(self) -> int:
        return self.grid.shape[0]

    @property
    def right(self) -> int:
        return self.x + self.cols

    @property
    def bottom(self) -> int:
        return self.y + self.rows

    def merge(self, other: Glyph, compat: bool = True) -> None:
        left, top = min(self.x, other.x), min(self.y, other.y)
        grid = np.zeros((max(self.bottom, other.bottom) - top, max(self.right, other.right) - left), bool)
        for g in (self, other):
            grid[g.y - top : g.bottom - top, g.x - left : g.right - left] |= g.grid
        self.grid = grid
        if not compat:
            self.x, self.y = left, top


def overlap_merges(a: Glyph, b: Glyph) -> bool:
    wide = min(a.right, b.right) - max(a.x, b.x)
    high = min(a.bottom, b.bottom) - max(a.y, b.y)
    return wide > 0 and high > 0 and wide * high >= min(a.cols * a.rows, b.cols * b.rows) * OVERLAP


@dataclass
class Band:
    glyphs: list[Glyph] = field(default_factory=list)
    _stats: tuple[int, int] | None = None

    def box(self, adjusted: bool) -> tuple[int, int, int, int]:
        if not self.glyphs:
            return 0, 0, 0, 0
        first = self.glyphs[0]
        at = [(g.ax, g.ay, g.cols, g.rows) if adjusted else (g.x, g.y, g.cols, g.rows) for g in self.glyphs]
        at = [(first.x, first.y, first.cols, first.rows), *at]
        return min(a[0] for a in at), min(a[1] for a in at), max(a[0] + a[2] for a in at), max(a[1] + a[3] for a in at)

    def refresh(self) -> None:
        """Width and kerning: sums leave out the first glyph but are divided by all (T7)."""
        n = len(self.glyphs)
        if n < 2:
            l, _, r, _ = self.box(True)
            self._stats = (r - l, -1)
            return
        gaps = sum(b.ax - (a.ax + a.cols) for a, b in zip(self.glyphs, self.glyphs[1:], strict=False))
        self._stats = (K.half_up(sum(g.cols for g in self.glyphs[1:]) / n), K.half_up(gaps / n))

    def stats(self) -> tuple[int, int]:
        """(average width, average kerning); -1 is asked for anew each time."""
        if self._stats is None or self._stats[0] == -1:
            self.refresh()
        return self._stats

    @property
    def width(self) -> int:
        return self.stats()[0]

    @property
    def kerning(self) -> int:
        if self._stats is None or self._stats[1] == -1:
            self.refresh()
        return self._stats[1]

    @property
    def text(self) -> str:
        return "".join(g.character for g in self.glyphs)

    def describe(self, index: int | None = None) -> str:
        l, t, r, b = self.box(True)
        spaces = sum(g.character == " " for g in self.glyphs)
        n = len(self.glyphs)
        text = f"[{n}] Avg(W:{self.width if n else 0}, H:{b - t} G:{self.kerning})"
        return text + (f" S[{spaces}]" if spaces else "")

    def pad(self) -> None:
        """All glyphs get the band's height."""
        _, top, _, bottom = self.box(False)
        for g in self.glyphs:
            above, below = g.y - top, bottom - g.bottom
            if above > 0 or below > 0:
                g.grid = K.pad(g.grid, above, below)
                g.y = top

    def sort(self) -> None:
        self.glyphs.sort(key=lambda g: g.ax)

    def wide(self) -> list[Glyph]:
        n = len(self.glyphs)
        if n < 2:
            return []
        if n == 2 and SAME_WIDTH[0] <= self.glyphs[0].cols / self.glyphs[1].cols <= SAME_WIDTH[1]:
            return []
        limit = self.width * (WIDE_FEW if n <= 3 else WIDE)
        for g in self.glyphs:
            g.inspect = g.cols > limit
        return [g for g in self.glyphs if g.inspect]

    def split(self, g: Glyph) -> list[Glyph]:
        cuts = K.split_offsets(g.grid, g.cols >= K.half_up(self.width * SOFT_FROM))
        return [Glyph(part.copy(), g.x + x, g.y, g.ax + x, g.ay, was_split=True) for x, part in K.split_columns(g.grid, cuts)]

    def substitute(self, g: Glyph, parts: list[Glyph]) -> None:
        at = next(i for i, x in enumerate(self.glyphs) if x is g)
        self.glyphs[at : at + 1] = parts
        self._stats = None

    def space_threshold(self, gaps: list[int]) -> int:
        if not gaps:
            return MIN_SPACE
        gaps = sorted(gaps)
        ratios = [(b / a if a > 0 else 0.0) for a, b in zip(gaps, gaps[1:], strict=False)]
        if ratios and max(ratios) >= JUMP:
            i = ratios.index(max(ratios))
            return max(MIN_SPACE, K.half_up((gaps[i] + gaps[i + 1]) / 2))
        return max(MIN_SPACE, K.half_up(gaps[len(gaps) // 2] * MEDIAN_FACTOR), K.half_up(self.width * WIDTH_FACTOR))

    def find_spaces(self) -> None:
        self.refresh()
        if len(self.glyphs) < 2:
            return
        gaps = [b.x - a.right for a, b in zip(self.glyphs, self.glyphs[1:], strict=False)]
        limit = self.space_threshold([g for g in gaps if g > 0])
        _, top, _, bottom = self.box(False)
        out = self.glyphs[:1]
        for left, right, gap in zip(self.glyphs, self.glyphs[1:], gaps, strict=False):
            if gap >= limit and gap - 2 * BORDER >= MIN_SPACE:
                out.append(Glyph(np.zeros((bottom - top, gap - 2 * BORDER), bool), left.right + BORDER, left.y, character=" "))
            out.append(right)
        self.glyphs = out

    def pack(self) -> None:
        """Adjusted places: from the band's left, a kerning apart."""
        if not self.glyphs:
            return
        at, top = self.box(False)[0], self.glyphs[0].y
        for g in self.glyphs:
            g.ax, g.ay = at, top
            at += g.cols + KERNING


def glyphs_of(grid: np.ndarray, x: int = 0, y: int = 0) -> list[Glyph]:
    """Components (8 neighbours) as glyphs, left to right, then by first cell."""
    label = K.labels(grid, True)
    found = [Glyph(label[t:b, l:r] == name, l + x, t + y, l, t) for name, l, t, r, b in K.boxes(label)]
    return sorted(found, key=lambda g: g.x)


def attach_specks(glyphs: list[Glyph], compat: bool = True) -> None:
    """Merges each speck into the nearest glyph that is large and near enough; specks stay in the list."""
    specks = [g for g in glyphs if K.is_speck(g.grid)]
    keep = [g for g in glyphs if not K.is_speck(g.grid)]
    if not keep or not specks:
        return
    wide, high = (K.half_up(sum(getattr(g, k) for g in keep) / len(keep)) for k in ("cols", "rows"))
    reach = max(1, K.half_up(min(wide, high) * ATTACH_DISTANCE))
    for s in specks:
        l, t, r, b = K.content(s.grid)
        best, least = None, 1 << 30
        for g in keep:
            gl, gt, gr, gb = K.content(g.grid)
            if r == l or gr == gl or (r - l) * (b - t) > (gr - gl) * (gb - gt) * ATTACH_AREA:
                continue
            if K.is_line(s.grid) and (b - t >= high * ATTACH_HEIGHT or r - l >= wide * ATTACH_WIDTH):
                continue
            if s.x < g.x - reach or s.right > g.right + reach or s.y < g.y - reach or s.bottom > g.bottom + reach:
                continue
            far = max(0, g.x - s.right, s.x - g.right, g.y - s.bottom, s.y - g.bottom)
            if far < least:
                best, least = g, far
        if best is not None:
            best.merge(s, compat)


def merge_overlaps(glyphs: list[Glyph], compat: bool = True) -> list[Glyph]:
    """Left to right, each glyph takes in the later ones that it overlaps by most of the smaller."""
    rest, out = sorted(glyphs, key=lambda g: g.x), []
    while rest:
        now, later = rest[0], []
        for g in rest[1:]:
            if overlap_merges(now, g):
                now.merge(g, compat)
            else:
                later.append(g)
        out.append(now)
        rest = later
    return out


def band_of_region(grid: np.ndarray, x: int, y: int, compat: bool = True) -> Band:
    found = glyphs_of(grid, x, y)
    attach_specks(found, compat)
    mean = K.half_up(sum(g.rows for g in found) / len(found)) if found else 0
    tall = K.half_up(mean * KEEP_HEIGHT)
    band = Band([g for g in found if not K.is_speck(g.grid) or K.is_line(g.grid) and g.rows >= tall])
    band.pad()
    band.glyphs = merge_overlaps(band.glyphs, compat)
    # What follows in the original can't merge anything (T6); its sort remains.
    if len(band.glyphs) > 1:
        band.sort()
    return band


def regions(grid: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of what hangs together after dilation, in reading order."""
    found = [b[1:] for b in K.boxes(K.labels(K.dilate(grid, K.kernel_size(grid.shape[1])), False))]
    return reading_order(found, lambda b: (b[0] + (b[2] - b[0]) // 2, b[1] + (b[3] - b[1]) // 2))


def reading_order(items: list, center, tolerance: float = ROW_TOLERANCE) -> list:
    """By rows of centres within the tolerance, then by x. The relation isn't transitive (T10); ties keep their order."""

    def compare(a, b) -> int:
        (ax, ay), (bx, by) = center(a), center(b)
        return ax - bx if abs(ay - by) <= tolerance else ay - by

    return sorted(items, key=cmp_to_key(compare))


def same_row(a: Band, b: Band) -> bool:
    (_, at, _, ab), (_, bt, _, bb) = a.box(True), b.box(True)
    gap = abs((at + (ab - at) // 2) - (bt + (bb - bt) // 2))
    return at <= bb and ab >= bt and gap < (ab - at + bb - bt) // 2 * ROW_RATIO


def join_bands(bands: list[Band]) -> list[Band]:
    """Bands of one row are joined while neighbours are near enough."""
    rows: list[list[Band]] = []
    for b in bands:
        if rows and same_row(rows[-1][-1], b):
            rows[-1].append(b)
        else:
            rows.append([b])
    gone: set[int] = set()
    for row in rows:
        row.sort(key=lambda b: b.box(True)[0])
        i = 0
        while i + 1 < len(row):
            west, east = row[i], row[i + 1]
            (_, wt, wr, wb), (el, et, _, eb) = west.box(True), east.box(True)
            if 0 < el - wr <= (eb - et + wb - wt) // 2 * JOIN_RATIO:
                west.glyphs += east.glyphs
                west._stats = None
                gone.add(id(east))
                del row[i + 1]
                i = 0
            else:
                i += 1
    return [b for b in bands if id(b) not in gone]


def layout(grid: np.ndarray, inner_split: bool = True, compat: bool = True) -> list[Band]:
    """Lines of glyphs with spaces, top to bottom."""
    if not grid.any():
        return []
    bands = []
    for l, t, r, b in regions(grid):
        band = band_of_region(K.crop(grid, l, t, r - l, b - t), l, t, compat)
        band.glyphs = [g for g in band.glyphs if g.grid.any()]
        if band.glyphs:
            bands.append(band)
    for band in bands:
        for g in band.glyphs:
            g.ax, g.ay = g.x, g.y
        band.sort()
    bands = join_bands(bands)

    def center(b: Band) -> tuple[int, int]:
        l, t, r, low = b.box(False)
        return l + (r - l) // 2, t + (low - t) // 2

    bands = reading_order(bands, center)
    for band in bands:
        band.pad()
        if inner_split:
            for g in band.wide():
                parts = band.split(g)
                if parts or compat:
                    band.substitute(g, parts)
        band.find_spaces()
        band.pack()
    return [b for b in bands if b.glyphs]


# ------------------------------------------------------------------ recognition


@dataclass(frozen=True)
class Templates:
    """Arrays by template; matrices by (template, font)."""

    characters: tuple[str, ...]
    features: np.ndarray  # (n, 4): enclosures, punctuation, line left, line right
    owner: np.ndarray  # (m,): which template a matrix belongs to
    bits: np.ndarray  # (m, rows * columns) bool

    @staticmethod
    def of(rows: list[dict]) -> Templates:
        """From rows of the template table (see sources/templates.py)."""
        grids = [(i, np.array([[c == "#" for c in line] for line in m["data"]])) for i, r in enumerate(rows) for m in r["matrices"] or []]
        return Templates(
            tuple(r["character"] for r in rows),
            np.array([[r["enclosures"], r["isPunctuation"], r["lineLeft"], r["lineRight"]] for r in rows], int).reshape(-1, 4),
            np.array([i for i, _ in grids], int),
            np.array([g.reshape(-1) for _, g in grids], bool).reshape(len(grids), -1),
        )


    @cached_property
    def prepared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matrices as numbers, their ink, where each template's begin, and the place of each in its template."""
        weights = self.bits.astype(np.float32)
        starts = np.flatnonzero(np.diff(self.owner, prepend=-1))
        within = np.arange(len(self.owner)) - np.repeat(starts, np.diff(np.append(starts, len(self.owner))))
        return weights, weights.sum(axis=1, keepdims=True), starts, within


def match_features(grid: np.ndarray) -> tuple[int, int, int, int]:
    return K.enclosures(grid), int(K.is_punctuation(grid)), int(K.vertical_line(grid, "left")), int(K.vertical_line(grid, "right"))


def scores(grid: np.ndarray, templates: Templates, supported: str = "") -> list[tuple[str, int, float]]:
    """(character, best matrix, score) of each template with two of four equal features, best first."""
    fits = (templates.features == np.array(match_features(grid))).sum(axis=1) >= QUORUM
    if supported:
        fits &= np.array([c in supported for c in templates.characters], bool)
    if not fits.any():
        return []
    norm = K.normalise(grid)
    both = np.stack([norm.reshape(-1), K.erode_soft(norm).reshape(-1)]).astype(np.float32)
    weights, ink, starts, within = templates.prepared
    common = weights @ both.T
    either = ink + both.sum(axis=1) - common
    iou = np.where(either > 0, common / np.maximum(either, 1), 0.0).astype(np.float64).max(axis=1)
    best, score = np.zeros(len(fits), int), np.zeros(len(fits))
    if len(starts):
        owner, most = templates.owner[starts], np.maximum.reduceat(iou, starts)
        sizes = np.diff(np.append(starts, len(iou)))
        score[owner] = BEST * most + AVERAGE * (np.add.reduceat(iou, starts) / sizes)
        best[owner] = np.minimum.reduceat(np.where(iou == np.repeat(most, sizes), within, len(iou)), starts)
    found = [(templates.characters[i], int(best[i]), float(score[i])) for i in np.flatnonzero(fits)]
    found.sort(key=lambda s: -s[2])
    return promote(found, norm, grid)


def promote(found: list[tuple[str, int, float]], norm: np.ndarray, grid: np.ndarray) -> list[tuple[str, int, float]]:
    """P gives way to a near R where there is a stroke at the lower right; then m to u where it is narrow."""

    def raise_(heads: str, others: str, allowed) -> None:
        other = next((i for i, s in enumerate(found) if s[0] in others), None)
        if found[0][0] in heads and other is not None and allowed(found[0][2] - found[other][2]):
            found.insert(0, found.pop(other))

    if K.lower_right_stroke(norm):
        raise_("Pp", "Rr", lambda gap: gap <= R_GAP)
    l, t, r, b = K.content(grid)
    aspect = (r - l) / (b - t) if b > t else 1.0
    few = K.stems(norm) <= MU_STEMS
    raise_("m", "u", lambda gap: few or aspect < MU_ASPECT and gap <= MU_GAP)
    return found


def _merges(band: Band, i: int, best: float, templates: Templates, supported: str, compat: bool) -> bool:
    """Whether glyph i is one with the next; then the band holds the merged one."""
    if i + 1 >= len(band.glyphs) or band.glyphs[i + 1].character:
        return False
    a, b = band.glyphs[i], band.glyphs[i + 1]
    wide, kerning, gap = band.width, band.kerning, b.x - a.right
    if not 0 <= gap <= (max(1, wide // 2) if kerning <= 0 else max(1, min(wide // 2, 2 * kerning))):
        return False
    lines = K.is_line(a.grid) and K.is_line(b.grid)
    narrow = wide > 0 and max(a.cols, b.cols) <= wide * NARROW
    small = wide > 0 and a.cols + b.cols + gap <= wide * MERGE_WIDTH
    if not (lines or narrow or small):
        return False
    other = scores(b.grid, templates, supported)
    one = replace(a)
    one.merge(b, compat)
    merged = scores(one.grid, templates, supported) if other else []
    if not merged or merged[0][2] < MERGE_SCORE:
        return False
    h = next((s for s in merged if s[0] in "Hh"), None)
    near = h is not None and h[2] >= MERGE_SCORE and merged[0][2] - h[2] <= H_GAP
    if not (merged[0][0] in "Hh" or near or merged[0][2] - max(best, other[0][2]) >= MERGE_GAIN):
        return False
    band.glyphs[i : i + 2] = [one]
    return True


def recognise(band: Band, templates: Templates, supported: str = "", compat: bool = True) -> str:
    """Assigns characters to a band's glyphs and returns its text.

    A merge or a split changes the band and starts it over. Merges take a glyph away and splits only narrow
    them, so the rounds end; they are bounded all the same.
    """
    for _ in range(4 * sum(g.cols for g in band.glyphs) + 4):
        for i, g in enumerate(band.glyphs):
            if g.character:
                continue
            found = scores(g.grid, templates, supported)
            if not found:
                continue
            if _merges(band, i, found[0][2], templates, supported, compat):
                break
            if found[0][2] < SPLIT_BELOW:
                g.inspect = True
                parts = band.split(g)
                if parts:
                    band.substitute(g, parts)
                    break
            g.character, g.score = found[0][0], float(found[0][2])
        else:
            break
    band.sort()
    return band.text
