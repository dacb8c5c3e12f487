"""Pixels: PNG bytes to rasters, perceptual hashes of their luma, padded tiles of them.

A raster is a row (image_id, width, height, channels, dtype, pixels), pixels row by row. Rasters go through Arrow batches, each for
itself; tiles leave a few at a time, so a task holds one raster and a handful of tiles.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from numbers import Integral, Real

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DTYPES = ("uint8", "uint16", "int16", "float32", "float64")
RASTER = "image_id {id}, width int, height int, channels int, dtype string, pixels binary"
TILE = "image_id {id}, tile_id string, x bigint, y bigint, valid_width bigint, valid_height bigint, size int, channels int, dtype string, pixels binary"
#: Fixed values of the PNG format: its signature, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Fixed values of the luma and of the resize: weights of red, green and blue in 1/65536, lobes of the kernel, bits of its weights.
LUMA, LOBES, BITS = (19595, 38470, 7471), 3.0, 22
TILES_A_BATCH = 16
#: Bytes of images that are unfiltered together.
BYTES = 1 << 22


def _unfiltered(images: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters of images of one size. A byte is predicted from those left, above and above left of it, so the bytes of one
    diagonal are independent: a diagonal of all images at a time, whatever the rows' filters."""
    rows = np.moveaxis(images, 0, 1)
    kinds, height, many = rows[:, :, 0].astype(np.int16), len(rows), len(images)
    data = np.moveaxis(rows[:, :, 1:].reshape(height, many, -1, step), 1, 2).astype(np.int16)  # row, column, image, sample
    width = data.shape[1]
    last, before = np.zeros((height + 1, many, step), np.int16), np.zeros((height + 1, many, step), np.int16)  # by row + 1
    for d in range(height + width - 1):
        low, high = max(0, d - width + 1), min(height - 1, d)
        at = np.arange(low, high + 1)
        left, up, corner, kind = last[low + 1 : high + 2], last[low : high + 1], before[low : high + 1], kinds[low : high + 1, :, None]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        value = (data[at, d - at] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)) & 255
        data[at, d - at] = value
        before[:] = last
        last[low + 1 : high + 2] = value
    return np.moveaxis(data, 2, 0).astype(np.uint8).reshape(many, height, -1)


def _filtered(data: bytes) -> tuple[np.ndarray, int, tuple]:
    """The rows of a PNG with their filters, the bytes of a whole pixel, and what _coloured asks for. Raises ValueError for other data."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, palette, packed, ended = 8, None, None, [], False
    while at + 12 <= len(data) and not ended:
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged chunk")
        head = body if kind == b"IHDR" else head
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        packed += [body] if kind == b"IDAT" else []
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended:
        raise ValueError("damaged PNG")
    width, height, depth, colour, _, _, interlaced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), *head[8:13]
    if colour not in SAMPLES or depth not in (1, 2, 4, 8) or interlaced or (colour == 3 and palette is None) or not width or not height:
        raise ValueError("PNG of a kind that is not supported")
    line = (width * SAMPLES[colour] * depth + 7) // 8
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    if len(raw) != height * (line + 1):
        raise ValueError("damaged pixels")
    return np.frombuffer(raw, np.uint8).reshape(height, line + 1), max(1, SAMPLES[colour] * depth // 8), (width, depth, colour, palette)


def _coloured(rows: np.ndarray, width: int, depth: int, colour: int, palette: np.ndarray | None) -> np.ndarray:
    height = len(rows)
    if depth < 8:
        shifts = np.arange(8 - depth, -1, -depth)
        rows = ((rows[:, :, None] >> shifts) & (2**depth - 1)).reshape(height, -1)[:, :width]
        rows = rows if colour == 3 else rows * (255 // (2**depth - 1))
    pixels = rows.astype(np.uint8).reshape(height, width, -1)
    if colour == 3:
        if int(pixels.max()) >= len(palette):
            raise ValueError("colour outside the palette")
        return palette[pixels[:, :, 0]]
    return pixels


def decode_png(data: bytes) -> np.ndarray:
    """height x width x channels of a PNG of up to 8 bits a sample, not interlaced; palettes become colours. Raises ValueError otherwise."""
    rows, step, told = _filtered(data)
    return _coloured(_unfiltered(rows[None], step)[0], *told)


def decode_pngs(files: Iterable[bytes]) -> Iterator[tuple[int, np.ndarray | ValueError]]:
    """(place, pixels or what is wrong) of each file, in any order. Images of one size are unfiltered together; at most BYTES of them wait."""
    waiting: dict[tuple, list] = {}
    held = 0

    def done() -> Iterator[tuple[int, np.ndarray | ValueError]]:
        for (_, step), group in waiting.items():
            for (at, _, told), rows in zip(group, _unfiltered(np.stack([rows for _, rows, _ in group]), step)):
                try:
                    yield at, _coloured(rows, *told)
                except ValueError as e:
                    yield at, e
        waiting.clear()

    for at, data in enumerate(files):
        try:
            rows, step, told = _filtered(data)
        except ValueError as e:
            yield at, e
            continue
        waiting.setdefault((rows.shape, step), []).append((at, rows, told))
        held += rows.size
        if held >= BYTES:
            yield from done()
            held = 0
    yield from done()


def encode_png(pixels: np.ndarray, kinds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> bytes:
    """A PNG of uint8 pixels (height x width x 1 to 4), its rows filtered by the kinds in turn."""
    height, width, channels = pixels.shape
    colour = {v: k for k, v in SAMPLES.items() if k != 3}[channels]
    flat = pixels.reshape(height, width * channels).astype(np.int16)
    up = np.vstack([np.zeros((1, flat.shape[1]), np.int16), flat[:-1]])
    left, corner = (np.hstack([np.zeros((height, channels), np.int16), v[:, :-channels]]) for v in (flat, up))
    guess = left + up - corner
    a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    kind = np.array([kinds[r % len(kinds)] for r in range(height)])[:, None]
    rows = (flat - np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)) & 255
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.hstack([kind, rows]).astype(np.uint8).tobytes())) + chunk(b"IEND", b"")


def luma(pixels: np.ndarray) -> np.ndarray:
    """Grey of each pixel; transparency is ignored."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return ((pixels[:, :, :3].astype(np.int64) @ np.array(LUMA) + 0x8000) >> 16).astype(np.uint8)


@lru_cache(maxsize=64)
def _kernel(size: int, out: int) -> list[tuple[int, np.ndarray]]:
    """For each output place, where its window begins and the window's whole-number weights."""
    scale = size / out
    wide, made = max(scale, 1.0), []
    for k in range(out):
        centre = (k + 0.5) * scale
        first, end = max(0, int(centre - LOBES * wide + 0.5)), min(size, int(centre + LOBES * wide + 0.5))
        x = (np.arange(first, end) - centre + 0.5) / wide
        w = np.where((x >= -LOBES) & (x < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
        w = w / w.sum() * (1 << BITS)
        made.append((first, np.trunc(np.where(w < 0, w - 0.5, w + 0.5)).astype(np.int64)))
    return made


def _narrowed(rows: np.ndarray, out: int) -> np.ndarray:
    """Each row resampled to `out` values, rounded to a byte."""
    if rows.shape[1] == out:
        return rows
    columns = [(rows[:, a : a + len(w)].astype(np.int64) @ w + (1 << BITS - 1)) >> BITS for a, w in _kernel(rows.shape[1], out)]
    return np.clip(np.stack(columns, axis=1), 0, 255).astype(np.uint8)


def resized(grey: np.ndarray, size: int) -> np.ndarray:
    """size x size by a windowed sinc, across first and then down, each pass rounded to bytes."""
    return _narrowed(_narrowed(grey, size).T, size).T


@lru_cache(maxsize=1)
def _cosines(size: int = 32, keep: int = 8) -> np.ndarray:
    k, n = np.arange(keep)[:, None], np.arange(size)
    return np.cos(np.pi * k * (n + 0.5) / size) * np.where(k == 0, math.sqrt(1 / size), math.sqrt(2 / size))


def perceptual_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest frequencies of the 32 x 32 luma are at least the median of all but the first."""
    low = _cosines() @ resized(luma(pixels), 32).astype(float) @ _cosines().T
    flat = low.reshape(-1)
    return f"{int(''.join('1' if v else '0' for v in flat >= np.median(flat[1:])), 2):016x}"


def image_hashes(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(name, phash, fault) of PNG files: the hash, or why there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, seen in decode_pngs(v.as_py() or b"" for v in batch.column(1)):
                found, fault = (None, str(seen)) if isinstance(seen, ValueError) else (perceptual_hash(seen), None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([found], pa.string()), pa.array([fault], pa.string())], names=[name, "phash", "fault"])

    kind = files.select(name).schema[0].dataType.simpleString()
    return files.select(name, content).mapInArrow(run, f"`{name}` {kind}, phash string, fault string")


def _pad(value: object, dtype: str) -> np.generic:
    """The padding as a value of the type; whole numbers must fit an integer type, and finite ones stay finite."""
    kind = np.dtype(dtype)
    if dtype not in DTYPES:
        raise TypeError(f"rasters are of {', '.join(DTYPES)}")
    if isinstance(value, (bool, np.bool_)) or not isinstance(value, Real):
        raise TypeError("the padding must be a number")
    if kind.kind in "iu":
        if not isinstance(value, Integral) and not (math.isfinite(value) and float(value).is_integer()):
            raise ValueError("the padding of whole numbers must be one")
        if not np.iinfo(kind).min <= int(value) <= np.iinfo(kind).max:
            raise ValueError(f"the padding does not fit {dtype}")
        return kind.type(int(value))
    if math.isfinite(value) and abs(float(value)) > float(np.finfo(kind).max):
        raise ValueError(f"the padding does not fit {dtype}")
    return kind.type(value)


def positions(length: int, size: int, stride: int) -> list[int]:
    """Starts of tiles that fit, and a last one flush with the end."""
    return [0] if length <= size else sorted({*range(0, length - size + 1, stride), length - size})


def tile_pixels(rasters: DataFrame, size: int, overlap: float = 0.0, pad: float = 0) -> DataFrame:
    """The tiles of each raster, from top to bottom and left to right; where a raster ends, a tile goes on with the padding."""
    if size <= 0 or not 0 <= overlap < 1:
        raise ValueError("size must be positive and overlap in [0, 1)")
    stride = max(1, round(size * (1 - overlap)))
    kind = rasters.select("image_id").schema[0].dataType.simpleString()

    def cut(image: object, width: int, height: int, channels: int, dtype: str, data: bytes) -> Iterator[tuple]:
        value = _pad(pad, dtype)
        if width <= 0 or height <= 0 or channels <= 0 or len(data) != width * height * channels * np.dtype(dtype).itemsize:
            raise ValueError(f"raster {image}: {len(data)} bytes are not {width} x {height} x {channels} of {dtype}")
        whole = np.frombuffer(data, dtype).reshape(height, width, channels)
        for y in positions(height, size, stride):
            for x in positions(width, size, stride):
                part = whole[y : y + size, x : x + size]
                tile = np.full((size, size, channels), value, dtype)
                tile[: part.shape[0], : part.shape[1]] = part
                yield image, f"{image}__x{x}_y{y}_s{size}", x, y, part.shape[1], part.shape[0], size, channels, dtype, tile.tobytes()

    names = [c.split()[0] for c in TILE.split(", ")]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            for at in range(batch.num_rows):
                held: list[tuple] = []
                for row in cut(*(c[at].as_py() for c in batch.columns)):
                    held.append(row)
                    if len(held) == TILES_A_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return rasters.select(*[c.split()[0] for c in RASTER.split(", ")]).mapInArrow(run, TILE.format(id=kind))


def rasters_of(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Rasters of PNG files, named by `name`; a damaged file raises."""
    kind = files.select(name).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                p = decode_png(batch.column(1)[at].as_py())
                row = [batch.column(0).slice(at, 1), *[pa.array([n], pa.int32()) for n in (p.shape[1], p.shape[0], p.shape[2])], pa.array(["uint8"]), pa.array([p.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in RASTER.split(", ")])

    return files.select(name, F.col(content)).mapInArrow(run, RASTER.format(id=kind))
