"""PNG, hash and tiles against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import matching, rasters


def picture(seed, height, width, channels):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    return np.stack([(x * (3 + k) + y * (7 - k) + 20 * np.sin(x / 5) + r.integers(0, 30, (height, width))) % 256 for k in range(channels)], axis=2).astype(np.uint8)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (4, 2, 0, 3, 1)])
def test_png_there_and_back(channels, kinds):
    p = picture(channels, 23, 17, channels)
    assert (rasters.decode_png(rasters.encode_png(p, kinds)) == p).all()


def chunks(*parts):
    return rasters.SIGNATURE + b"".join(len(b).to_bytes(4, "big") + n + b + zlib.crc32(n + b).to_bytes(4, "big") for n, b in parts)


def test_few_bits_and_palettes():
    head = lambda d, c: (9).to_bytes(4, "big") + (2).to_bytes(4, "big") + bytes([d, c, 0, 0, 0])
    bits = zlib.compress(bytes([0, 0b10110010, 0b10000000, 0, 0b01001101, 0]))
    grey = rasters.decode_png(chunks((b"IHDR", head(1, 0)), (b"IDAT", bits), (b"IEND", b"")))
    assert grey[:, :, 0].tolist() == [[255 * int(b) for b in "101100101"], [255 * int(b) for b in "010011010"]]
    coloured = rasters.decode_png(chunks((b"IHDR", head(1, 3)), (b"PLTE", bytes([1, 2, 3, 250, 251, 252])), (b"IDAT", bits), (b"IEND", b"")))
    assert coloured[0, 0].tolist() == [250, 251, 252] and coloured[0, 1].tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        rasters.decode_png(chunks((b"IHDR", head(1, 3)), (b"PLTE", bytes([1, 2, 3])), (b"IDAT", bits), (b"IEND", b"")))
    with pytest.raises(ValueError):
        rasters.decode_png(chunks((b"IHDR", head(16, 0)), (b"IDAT", bits), (b"IEND", b"")))


def plain_hash(pixels):
    """The same hash by loops over floats and whole numbers."""
    height, width, channels = pixels.shape
    grey = [[int(p[0]) if channels < 3 else (int(p[0]) * 19595 + int(p[1]) * 38470 + int(p[2]) * 7471 + 0x8000) >> 16 for p in row] for row in pixels]

    def kernel(x):
        sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
        return sinc(x) * sinc(x / 3) if -3 <= x < 3 else 0.0

    def row_to(row, out):
        if len(row) == out:
            return row
        scale, made = len(row) / out, []
        wide = max(scale, 1.0)
        for k in range(out):
            centre = (k + 0.5) * scale
            a, b = max(0, int(centre - 3 * wide + 0.5)), min(len(row), int(centre + 3 * wide + 0.5))
            w = [kernel((i - centre + 0.5) / wide) for i in range(a, b)]
            whole = [int(v / sum(w) * (1 << 22) + (0.5 if v >= 0 else -0.5)) for v in w]
            made.append(min(255, max(0, (sum(v * row[a + i] for i, v in enumerate(whole)) + (1 << 21)) >> 22)))
        return made

    across = [row_to(r, 32) for r in grey]
    down = [row_to([across[y][x] for y in range(height)], 32) for x in range(32)]
    c = lambda k, n: math.cos(math.pi * k * (2 * n + 1) / 64) * math.sqrt((1 if k == 0 else 2) / 32)
    low = [sum(c(u, y) * c(v, x) * down[x][y] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    median = sorted(low[1:])[31]
    return f"{int(''.join('1' if v >= median else '0' for v in low), 2):016x}"


@pytest.mark.parametrize(("height", "width", "channels"), [(40, 51, 3), (32, 32, 1), (20, 90, 4), (7, 32, 2), (33, 31, 3)])
def test_hash(height, width, channels):
    p = picture(5, height, width, channels)
    assert rasters.perceptual_hash(p) == plain_hash(p)


def test_hashes_of_files_feed_the_join(spark):
    same, other = picture(1, 60, 60, 3), picture(2, 50, 70, 1)
    noisy = np.clip(same.astype(int) + (np.indices(same.shape).sum(axis=0) % 2), 0, 255).astype(np.uint8)
    good = rasters.encode_png(same)
    files = [("a", "g1", good), ("b", "g2", rasters.encode_png(noisy, (4,))), ("c", "g3", rasters.encode_png(other)), ("cut", "g4", good[:-30]), ("bad", "g5", good[:60] + b"x" + good[61:]), ("text", "g6", b"hello"), ("none", "g7", None)]
    df = spark.createDataFrame([(s, g, bytearray(c) if c is not None else None) for s, g, c in files], "stem string, group_id string, content binary")
    rows = {r["stem"]: r for r in rasters.image_hashes(df, "stem").collect()}
    assert rows["a"]["phash"] == rasters.perceptual_hash(same) and all(rows[n]["phash"] is None and rows[n]["fault"] for n in ("cut", "bad", "text", "none"))
    hashes = rasters.image_hashes(df, "stem").where("phash is not null").join(df.select("stem", "group_id"), "stem")
    assert [(r["left"], r["right"]) for r in matching.hamming_pairs(hashes).collect()] == [("a", "b")]
    whole = rasters.rasters_of(df.where("stem in ('a', 'c')"), "stem").orderBy("image_id").collect()
    assert [(r["image_id"], r["width"], r["height"], r["channels"]) for r in whole] == [("a", 60, 60, 3), ("c", 70, 50, 1)] and bytes(whole[0]["pixels"]) == same.tobytes()


RASTER = rasters.RASTER.format(id="bigint")


def test_tiles_make_the_image_again(spark):
    r, images = random.Random(2), {}
    for k, dtype in enumerate(rasters.DTYPES):
        h, w, c = r.randint(1, 90), r.randint(1, 90), r.choice([1, 3])
        images[k] = (np.arange(h * w * c).reshape(h, w, c) % 120).astype(dtype)
    df = spark.createDataFrame([(k, a.shape[1], a.shape[0], a.shape[2], str(a.dtype), bytearray(a.tobytes())) for k, a in images.items()], RASTER)
    made = {k: np.full_like(a, 125) for k, a in images.items()}
    for t in rasters.tile_pixels(df, 32, 0.25, 77).collect():
        tile = np.frombuffer(bytes(t["pixels"]), t["dtype"]).reshape(t["size"], t["size"], t["channels"])
        made[t["image_id"]][t["y"] : t["y"] + t["valid_height"], t["x"] : t["x"] + t["valid_width"]] = tile[: t["valid_height"], : t["valid_width"]]
        assert (tile[t["valid_height"] :] == 77).all() and (tile[:, t["valid_width"] :] == 77).all() and t["tile_id"] == f"{t['image_id']}__x{t['x']}_y{t['y']}_s32"
    assert all((made[k] == a).all() for k, a in images.items())
    assert rasters.tile_pixels(df.where(F.lit(False)), 32).count() == 0


@pytest.mark.parametrize(("value", "dtype"), [(256, "uint8"), (-1, "uint16"), (0.5, "int16"), (math.nan, "uint8"), (1e39, "float32")])
def test_padding_that_does_not_fit(value, dtype):
    with pytest.raises(ValueError):
        rasters._pad(value, dtype)


def test_padding_of_another_kind():
    for value in (True, "0", None):
        with pytest.raises(TypeError):
            rasters._pad(value, "uint8")
    assert np.isnan(rasters._pad(math.nan, "float32")) and rasters._pad(3.0, "uint8") == 3


def test_images_unfiltered_together(monkeypatch):
    """Files of several sizes and kinds and damaged ones, few at a time: as one by one."""
    r = np.random.default_rng(5)
    images = [r.integers(0, 256, (5 + k % 3, 7 + k % 2, (1, 3)[k % 4 == 0]), dtype=np.uint8) for k in range(24)]
    files = [rasters.encode_png(p, (k % 5, 4, 3)) for k, p in enumerate(images)]
    files[3] = b"no"
    for most in (1, 200, 1 << 22):
        monkeypatch.setattr(rasters, "BYTES", most)
        found = dict(rasters.decode_pngs(files))
        assert sorted(found) == list(range(24)) and str(found[3]) == "no PNG"
        assert all((found[k] == images[k]).all() and found[k].shape == images[k].shape for k in range(24) if k != 3)
