"""Progressive JPEG as a media column: reading to full-resolution RGB tensors, and a lossless store for bytes.

``read_coefficients`` follows the scans of a progressive file: spectral selection (a scan has a band of
coefficients) and successive approximation (a scan has a further bit of them) are accumulated in one array of
coefficients for each component. ``to_rgb`` multiplies by the quantisation tables, inverse-transforms all
blocks at once in numpy, upsamples chroma to full resolution and converts to RGB.

``write_payload`` stores bytes without loss in such a file. The unit is the coefficient: a byte b becomes b if it
is 128 or more, else -(128 + b), in zigzag order of 8 x 8 blocks, luma blocks first; quantisation is by 1. All
magnitudes lie in 128..255, so that every coefficient of a first AC scan has category 7 and each refinement is
one run of correction bits: valid scans of fixed width, which numpy reads and writes whole. Other files
take the general path of the reader, symbol by symbol.

Nulls: a null media value gives null results; a broken file raises ValueError, or gives nulls where the caller
asks for that. A null text is stored as an empty one, which is one unit of padding; so equal texts, null and empty ones
too, have equal files. Rows are handled one by one, so ties and repeated rows don't matter. A text of any length is one file,
which one task holds with its coefficients. Stored are an id and a text, whatever other columns there are; read_images()
keeps all columns but one named image, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import in_parts, lean, small_batches

UNIT = 576

#: Natural index of each place in zigzag order: along the anti-diagonals, turning at each.
ZIGZAG = np.array(
    [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[(sum(x) + 1) % 2]))]
)
_DCT = np.array(
    [[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
)
_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


@dataclass
class Component:
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row that belong to the image (for scans of this component alone)
    high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.empty(0))  # (rows, columns, 64), zigzag


@dataclass
class Frame:
    width: int
    height: int
    components: dict[int, Component]
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = (max(getattr(c, k) for c in self.components.values()) for k in "hv")
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


class _Bits:
    """Bits of a scan, first bit highest."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data + b"\0\0\0\0", 0, 8 * len(data)

    def peek16(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3].ljust(3, b"\0"), "big") >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        i = self.at >> 3
        word = int.from_bytes(self.data[i : i + 4].ljust(4, b"\0"), "big")
        v = (word >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.size + 64:
            raise ValueError("a scan ends too early")
        return v

    def symbol(self, codes: list) -> int:
        length, value = codes[self.peek16()] or (0, 0)
        if not length:
            raise ValueError("no such code")
        self.at += length
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def array(self, n: int) -> np.ndarray:
        """n single bits."""
        if self.at + n > self.size:
            raise ValueError("a scan ends too early")
        first = self.at >> 3
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, (self.at + n + 7 >> 3) - first, first))
        skip = self.at & 7
        self.at += n
        return bits[skip : skip + n]


def _lookup(lengths: bytes, values: bytes) -> list:
    """(length, value) by the next 16 bits."""
    out: list = [None] * 65536
    code = at = 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = [(n, values[at])] * (1 << (16 - n))
            code += 1
            at += 1
        code <<= 1
    return out


@dataclass
class _Table:
    lengths: bytes
    values: bytes
    _codes: list | None = None

    @property
    def codes(self) -> list:
        if self._codes is None:
            key = (self.lengths, self.values)
            if key not in _KNOWN:
                if len(_KNOWN) > 64:
                    _KNOWN.clear()
                _KNOWN[key] = _lookup(*key)
            self._codes = _KNOWN[key]
        return self._codes

    @property
    def only(self) -> tuple[int, int] | None:
        """(length, value) of the single code of a table of one."""
        return (next(i for i, n in enumerate(self.lengths, 1) if n), self.values[0]) if sum(self.lengths) == 1 else None


_KNOWN: dict[tuple[bytes, bytes], list] = {}


def read_coefficients(data: bytes) -> Frame:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame = 2, None
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, _Table] = {}
    comments: list[bytes] = []
    restart = 0
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[name] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            frame = _frame(body)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive files with Huffman codes are read")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan comes before its frame")
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            _scan(frame, body, data[at:stop], codes, restart)
            at = stop
    if frame is None:
        raise ValueError("no frame")
    frame.tables, frame.comments = quant, comments
    return frame


def _frame(body: bytes) -> Frame:
    height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
    parts = {body[i]: Component(body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
    if body[0] != 8 or not width or not height or not parts:
        raise ValueError("not an 8-bit frame with a size")
    frame = Frame(width, height, parts)
    rows, cols = frame.mcus
    h, v = (max(getattr(c, k) for c in parts.values()) for k in "hv")
    for c in parts.values():
        c.wide, c.high = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
        c.coefficients = np.zeros((rows * c.v, cols * c.h, 64), np.int32)
    return frame


def _scan(frame: Frame, head: bytes, data: bytes, codes: dict[int, _Table], restart: int) -> None:
    n = head[0]
    parts = [(frame.components[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    # What a restart interval holds; without restarts there is one.
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in (re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data])]
    rows, cols = frame.mcus
    if n == 1:
        c = parts[0][0]
        blocks = c.coefficients[: c.high, : c.wide]
        order = [(0, y, x) for y in range(c.high) for x in range(c.wide)] if first == 0 and not high or restart else None
        units = c.high * c.wide
    else:
        blocks, units = None, rows * cols
        order = None
    if first == 0 and high and not restart:
        bits = _Bits(pieces[0])
        where = _dc_places(frame, parts, n)
        got = bits.array(sum(len(i) for _, i, _ in where)) if n == 1 else None
        if n == 1:
            c, ys, xs = where[0]
            c.coefficients[ys, xs, 0] |= got.astype(np.int32) << low
            return
        per = sum(c.h * c.v for c, _ in parts)
        got = bits.array(rows * cols * per).reshape(rows * cols, per).astype(np.int32)
        k = 0
        for c, ys, xs in where:
            many = c.h * c.v
            c.coefficients[ys, xs, 0] |= got[:, k : k + many].reshape(-1) << low
            k += many
        return
    if first == 0:
        _dc_scan(frame, parts, n, pieces, codes, high, low, restart, units, order)
        return
    table = codes[0x10 | (parts[0][1] & 15)]
    band = slice(first, last + 1)
    if not high and not restart and table.only and table.only[1] >> 4 == 0 and table.only[1] & 15:
        # One code for all: each coefficient has the same number of bits.
        skip, size = table.only[0], table.only[1] & 15
        count = units * (last + 1 - first)
        raw = pieces[0]
        if skip + size == 8 and len(raw) >= count:
            v = np.frombuffer(raw, np.uint8, count).astype(np.int32) & ((1 << size) - 1)
        else:
            bits = _Bits(raw).array(count * (skip + size)).reshape(count, skip + size)[:, skip:].astype(np.int32)
            v = bits @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        v = np.where(v >> (size - 1), v, v - (1 << size) + 1) << low
        blocks[:, :, band] = v.reshape(*blocks.shape[:2], -1)
        return
    _ac_scan(blocks, pieces, table.codes, first, last, high, low, restart)


def _dc_places(frame: Frame, parts: list, n: int) -> list:
    """Of each component of a scan: rows and columns of its blocks, in the order of the scan."""
    rows, cols = frame.mcus
    out = []
    for c, _ in parts:
        if n == 1:
            ys, xs = np.divmod(np.arange(c.high * c.wide), c.wide)
        else:
            my, mx, y, x = np.unravel_index(np.arange(rows * cols * c.v * c.h), (rows, cols, c.v, c.h))
            ys, xs = my * c.v + y, mx * c.h + x
        out.append((c, ys, xs))
    return out


def _dc_scan(frame, parts, n, pieces, codes, high, low, restart, units, order) -> None:
    tables = [None if high else codes[t >> 4].codes for _, t in parts]
    places = _dc_places(frame, parts, n)
    per = [1] if n == 1 else [c.h * c.v for c, _ in parts]
    step = restart or units
    got: list[list[int]] = [[] for _ in parts]
    for piece, begin in zip(pieces, range(0, units, step), strict=False):
        bits, before = _Bits(piece), [0] * len(parts)
        for _ in range(begin, min(units, begin + step)):
            for i, many in enumerate(per):
                for _ in range(many):
                    if high:
                        got[i].append(bits.take(1))
                    else:
                        before[i] += bits.signed(bits.symbol(tables[i]))
                        got[i].append(before[i])
    for (c, ys, xs), values in zip(places, got, strict=True):
        v = np.array(values, np.int32) << low
        if len(v) != len(ys):
            raise ValueError("a scan ends too early")
        if high:
            c.coefficients[ys, xs, 0] |= v
        else:
            c.coefficients[ys, xs, 0] = v


def _ac_scan(blocks: np.ndarray, pieces: list[bytes], codes: list, first: int, last: int, high: int, low: int, restart: int) -> None:
    """A scan of AC coefficients, symbol by symbol; runs of refined blocks without news are done at once."""
    flat = blocks.reshape(-1, 64) if blocks.flags.c_contiguous else blocks.copy().reshape(-1, 64)
    step = restart or len(flat)
    one = 1 << low
    for piece, begin in zip(pieces, range(0, len(flat), step), strict=False):
        bits, i, end = _Bits(piece), begin, min(len(flat), begin + step)
        run = 0
        while i < end:
            if run:
                if high:
                    _refine(flat[i : i + run, first : last + 1], bits, one)
                i += run
                run = 0
                continue
            k, row = first, flat[i]
            while k <= last:
                symbol = bits.symbol(codes)
                zeros, size = symbol >> 4, symbol & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                if not high:
                    k += zeros
                    if size:
                        if k > last:
                            raise ValueError("a coefficient lies beyond its band")
                        row[k] = bits.signed(size) << low
                    k += 1
                    continue
                new = (one if bits.take(1) else -one) if size else 0
                while k <= last:
                    if row[k]:
                        if bits.take(1) and not abs(int(row[k])) & one:
                            row[k] += one if row[k] > 0 else -one
                    else:
                        if not zeros:
                            row[k] = new
                            k += 1
                            break
                        zeros -= 1
                    k += 1
            if run:
                # The rest of this block belongs to the run.
                if high and k <= last:
                    _refine(row[None, k : last + 1], bits, one)
                run -= 1
            i += 1
    if flat.base is not blocks and not np.shares_memory(flat, blocks):
        blocks[...] = flat.reshape(blocks.shape)


def _refine(rows: np.ndarray, bits: _Bits, one: int) -> None:
    """A correction bit for each coefficient that isn't 0, in order."""
    at = np.nonzero(rows)
    old = rows[at]
    set_ = bits.array(len(old)).astype(bool) & (np.abs(old) & one == 0)
    rows[at] = old + np.where(set_, np.sign(old) * one, 0)


def to_rgb(frame: Frame) -> np.ndarray:
    """(height, width, 3) uint8: dequantised, inverse-transformed, chroma upsampled by repetition."""
    h, v = (max(getattr(c, k) for c in frame.components.values()) for k in "hv")
    planes = []
    for c in frame.components.values():
        rows, cols, _ = c.coefficients.shape
        natural = np.empty((rows * cols, 64))
        natural[:, ZIGZAG] = (c.coefficients * frame.tables[c.table]).reshape(-1, 64)
        pixels = (_DCT.T @ natural.reshape(-1, 8, 8)) @ _DCT
        plane = pixels.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        plane = np.clip(np.floor(plane + 128.5), 0, 255)
        if (c.v, c.h) != (v, h):
            ys = np.arange(frame.height) * c.v // v
            xs = np.arange(frame.width) * c.h // h
            plane = plane[ys][:, xs]
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) < 3:
        return np.repeat(planes[0][..., None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- the lossless store


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: Categories 0..8 of DC differences, 4 bits each; the one category of first AC scans; runs of blocks.
_DC_TABLE = _segment(0xC4, bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)]))
_AC_TABLE = _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0x07]))
_RUN_TABLE = _segment(0xC4, bytes([0x11, 0, 0, 0, 15, *[0] * 12, *(n << 4 for n in range(15))]))
_CATEGORY = np.array([int(d).bit_length() for d in range(512)])
#: (component, tables, first, last): luma's AC coefficients come in two bands.
_BANDS = ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))


def _packed(bits: np.ndarray) -> bytes:
    """Whole bytes, filled with ones, 0xFF followed by 0."""
    rest = -len(bits) % 8
    if rest:
        bits = np.concatenate((bits, np.ones(rest, bits.dtype)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _digits(values: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """The lowest lengths[i] bits of values[i], one after the other."""
    places = np.arange(most - 1, -1, -1)
    bits = (values[:, None] >> places) & 1
    return bits[places < lengths[:, None]].astype(np.uint8)


def padded(payload: bytes) -> bytes:
    return payload + b"\xff" * (max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def write_payload(payload: bytes) -> bytes:
    """A progressive file (4:2:0) that holds payload, whose length is a positive multiple of 64."""
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    cols = int(np.ceil(np.sqrt(mcus)))
    rows = -(-mcus // cols)
    n = rows * cols
    if cols * 16 > 65535:
        raise ValueError("the payload is too long for one image")
    raw = np.full(n * 6 * 64, 255, np.int32)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = np.where(raw >= 128, raw, -128 - raw).reshape(-1, 64)
    parts = {1: values[: 4 * n], 2: values[4 * n : 5 * n], 3: values[5 * n :]}
    # DC values in the order of MCUs: four of luma, one of each chroma.
    luma = parts[1][:, 0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    dc = np.concatenate((luma, parts[2][:, :1], parts[3][:, :1]), axis=1)
    coarse = dc >> 1
    diffs = np.empty_like(coarse)
    diffs[:, :4] = np.diff(coarse[:, :4].reshape(-1), prepend=0).reshape(n, 4)
    diffs[:, 4:] = np.diff(coarse[:, 4:], axis=0, prepend=np.zeros((1, 2), coarse.dtype))
    d = diffs.reshape(-1)
    size = _CATEGORY[np.abs(d)]
    code = (size << size) | np.where(d > 0, d, d + (1 << size) - 1)
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload " + str(len(payload)).encode()),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, bytes([8, *(rows * 16).to_bytes(2, "big"), *(cols * 16).to_bytes(2, "big"), 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _DC_TABLE, _AC_TABLE, _RUN_TABLE,
        _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x01])), _packed(_digits(code, size + 4, 12)),
    ]
    for c, first, last in _BANDS:
        v = parts[c][:, first : last + 1]
        coarse = np.abs(v) >> 1
        # The code 0 and seven bits: a byte, and never 0xFF.
        out += [_segment(0xDA, bytes([1, c, 0x00, first, last, 0x01])), np.where(v > 0, coarse, 127 - coarse).astype(np.uint8).tobytes()]
    out += [_segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])), _packed((dc & 1).reshape(-1).astype(np.uint8))]
    for c in (1, 2, 3):
        fine = (np.abs(parts[c][:, 1:]) & 1).astype(np.uint8)
        bits = []
        for at in range(0, len(fine), 32767):
            run = fine[at : at + 32767]
            k = len(run).bit_length() - 1
            bits += [_digits(np.array([(k << k) | (len(run) - (1 << k))]), np.array([k + 4]), 18), run.reshape(-1)]
        out += [_segment(0xDA, bytes([1, c, 0x01, 1, 63, 0x10])), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(frame: Frame) -> bytes:
    """What write_payload() stored."""
    length = next((int(c[8:]) for c in frame.comments if c.startswith(b"payload ")), None)
    if length is None:
        raise ValueError("no payload")
    v = np.concatenate([frame.components[c].coefficients.reshape(-1) for c in (1, 2, 3)])[:length]
    return np.where(v > 0, v, -v - 128).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- columns


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary): each whole text, padded to a positive multiple of 576 bytes, as a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "text"):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
            media = [write_payload(padded(x)) for x in raw]
            yield pa.record_batch(
                [b[id_col], pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())],
                names=[id_col, "n_bytes", "media"],
            )

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(write), f"`{id_col}` {kind}, n_bytes long, media binary")


def read_images(df: DataFrame, media_col: str = "media", *, broken_to_null: bool = False) -> DataFrame:
    """df with image: struct(width int, height int, rgb binary), the full-resolution tensor, row by row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for m in b[media_col].to_pylist():
                try:
                    rgb = None if m is None else to_rgb(read_coefficients(m))
                except (ValueError, IndexError, KeyError):
                    if not broken_to_null:
                        raise
                    rgb = None
                made.append(None if rgb is None else {"width": rgb.shape[1], "height": rgb.shape[0], "rgb": rgb.tobytes()})
            image = pa.array(made, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary())]))
            yield pa.record_batch([*b.columns, image], names=[*b.schema.names, "image"])

    bare = df.drop("image")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.schema)
    return bare.mapInArrow(read, f"{kinds}, image struct<width:int,height:int,rgb:binary>")


def image_features(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and mean absolute difference of neighbours, in hundredths."""
    n = rgb.shape[0] * rgb.shape[1]
    means = (rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 100 // n).tolist()
    g = rgb[..., 1].astype(np.int16)
    edges = [int(np.abs(np.diff(g, axis=a)).sum(dtype=np.int64)) * 100 // n for a in (0, 1)]
    return f"{rgb.shape[1]}x{rgb.shape[0]} rgb " + " ".join(map(str, means)) + " edges " + " ".join(map(str, edges))


def media_digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From store_texts(): what reading the stored bytes back gives, by row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "media"):
            cols: list[list] = [[] for _ in range(6)]
            for m in b["media"].to_pylist():
                frame = read_coefficients(m)
                payload = payload_of(frame)
                for c, v in zip(
                    cols,
                    (
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m),
                        hashlib.sha256(m).hexdigest(), image_features(to_rgb(frame)),
                    ),
                    strict=True,
                ):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch(
                [b[id_col], b["n_bytes"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.mapInArrow(
        lean(digest),
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )
