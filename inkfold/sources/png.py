"""Image bytes in a column: PNG read and written by numpy in Arrow steps.

Read are gray, gray with alpha, palette, RGB and RGBA images of 1 to 16 bits that aren't interlaced; alpha is dropped and
16 bits are cut to 8. Written are 8-bit gray and RGB images.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    """Lines of bytes from filtered ones; step is the distance of bytes that belong to neighbouring pixels."""
    lines = raw.reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)  # the line above the first is zero
    for y, (kind, line) in enumerate(zip(lines[:, 0], lines[:, 1:], strict=True), 1):
        above = out[y - 1]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:
            for k in range(step):
                out[y, k::step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            for k in range(step):
                left = corner = 0
                for x in range(k, stride, step):
                    up = int(above[x])
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        near = sorted(((abs(left + up - corner - v), i, v) for i, v in enumerate((left, up, corner))))
                        guess = near[0][2]
                    left, corner = (int(line[x]) + guess) & 255, up
                    out[y, x] = left
        else:
            raise ValueError(f"PNG filter {kind}")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """(rows, columns, 1 or 3) bytes."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None:
        raise ValueError("a PNG image without a header")
    cols, rows, bits, colour, _, _, interlaced = head
    if colour not in SAMPLES or interlaced:
        raise ValueError("this kind of PNG image isn't read")
    samples = SAMPLES[colour]
    stride = -(-cols * samples * bits // 8)
    lines = _unfiltered(np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8), rows, stride, max(1, samples * bits // 8))
    if bits < 8:
        lines = np.unpackbits(lines, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits)[::-1])
        if colour == 0:
            lines = lines * 255 // ((1 << bits) - 1)
    elif bits == 16:
        lines = lines[:, ::2]
    pixels = lines[:, : cols * samples].astype(np.uint8).reshape(rows, cols, samples)
    if colour == 3:
        return palette[pixels[..., 0]]
    return pixels[..., :3] if samples >= 3 else pixels[..., :1]


def write_png(pixels: np.ndarray) -> bytes:
    """From (rows, columns) or (rows, columns, 3) bytes."""
    rows, cols = pixels.shape[:2]
    lines = np.ascontiguousarray(pixels, np.uint8).reshape(rows, -1)
    raw = np.concatenate([np.zeros((rows, 1), np.uint8), lines], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", cols, rows, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_images(df: DataFrame, id_col: str, bytes_col: str, broken_to_null: bool = False) -> DataFrame:
    """(image_id, cols, rows, channels, data), as read_images() of grids.py returns it, from a column of PNG bytes.

    Null bytes give null. Broken ones fail, or give null as well."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for v in b["bytes"]:
                try:
                    pixels = None if v.as_py() is None else read_png(v.as_py())
                except (ValueError, IndexError, TypeError, struct.error, zlib.error):
                    if not broken_to_null:
                        raise
                    pixels = None
                cells.append((None,) * 4 if pixels is None else (pixels.shape[1], pixels.shape[0], pixels.shape[2], pixels[..., ::-1].tobytes()))
            cols, rows, channels, data = zip(*cells, strict=True) if cells else ((),) * 4
            yield pa.record_batch(
                [b["image_id"], pa.array(cols, pa.int32()), pa.array(rows, pa.int32()), pa.array(channels, pa.int32()), pa.array(data, pa.binary())],
                names=["image_id", "cols", "rows", "channels", "data"],
            )

    named = df.select(F.col(f"`{id_col}`").cast("string").alias("image_id"), F.col(f"`{bytes_col}`").alias("bytes"))
    return named.mapInArrow(decoded, "image_id string, cols int, rows int, channels int, data binary")


def encode_images(grid: Column) -> Column:
    """PNG bytes of packed grids: ink is black on white. Null for null and for a grid without cells."""

    @F.arrow_udf("binary")
    def encoded(grids: pa.Array) -> pa.Array:
        out = []
        for g in grids.to_pylist():
            some = g is not None and g["cols"] and g["rows"]
            out.append(write_png(255 * (1 - np.frombuffer(g["bits"], np.uint8).reshape(g["rows"], g["cols"]))) if some else None)
        return pa.array(out, pa.binary())

    return encoded(grid)


def samples(df: DataFrame, id_col: str, grid_col: str, expected_col: str) -> DataFrame:
    """A manifest of samples: (image_id, media, expected)."""
    return df.select(F.col(f"`{id_col}`").cast("string").alias("image_id"), encode_images(F.col(f"`{grid_col}`")).alias("media"), F.col(f"`{expected_col}`").alias("expected"))
