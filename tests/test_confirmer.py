"""Crops and partitions of the confirmer's examples."""

import glob
import json
import random

import numpy as np
import pytest

from boxwright.operators import confirmer, rasters
from boxwright.operators.confirmer import CropPolicy


def test_bilinear_is_near_the_plain_one():
    r = np.random.default_rng(1)
    for h, w, out in ((7, 9, 16), (40, 31, 12), (5, 5, 5), (1, 1, 4)):
        p = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        want = np.zeros((out, out, 3))
        for y in range(out):
            for x in range(out):
                fy, fx = min(max((y + 0.5) * h / out - 0.5, 0), h - 1), min(max((x + 0.5) * w / out - 0.5, 0), w - 1)
                a, b = int(fy), int(fx)
                c, d = min(a + 1, h - 1), min(b + 1, w - 1)
                u, v = fy - a, fx - b
                want[y, x] = (p[a, b] * (1 - u) * (1 - v) + p[a, d] * (1 - u) * v + p[c, b] * u * (1 - v) + p[c, d] * u * v)
        assert np.abs(confirmer.bilinear(p, out).astype(float) - want).max() <= 1.01
    same = r.integers(0, 256, (8, 8, 1)).astype(np.uint8)
    assert (confirmer.bilinear(same, 8) == same).all()


def test_a_crop_over_the_edge_is_black_there():
    p = np.full((30, 40, 3), 200, np.uint8)
    c = confirmer.crop(p, (-4, -4, 4, 4), CropPolicy(2.0, 16, 16, 16))
    assert (c[:7, :7] == 0).all() and (c[9:, 9:] == 200).all()
    assert (confirmer.crop(p, (500, 500, 510, 510), CropPolicy(2.0, 16, 16, 16)) == 0).all()


@pytest.mark.parametrize("wrong", [{"context_scale": 0}, {"context_scale": float("nan")}, {"min_side": 9, "max_side": 8}, {"holdout_ratio": 1.0}, {"seed": -1}, {"output_size": 0}])
def test_wrong_policies(wrong):
    with pytest.raises(ValueError):
        CropPolicy(**wrong)


def test_dataset(spark, tmp_path):
    r = random.Random(5)
    images = [(i, f"g{i // 2}", 60, 50) for i in range(20)]
    rows = []
    for i, *_ in images:
        for k in range(4):
            x, y = r.uniform(0, 50), r.uniform(0, 40)
            reason = r.choice(["recoverable_truth", "background", "duplicate_proposal", "duplicate_main"])
            rows.append((i, 100 * i + k, int(reason == "recoverable_truth"), reason, r.random(), x, y, x + 8, y + 6))
    labelled = spark.createDataFrame(rows, "image_id bigint, ord bigint, label int, reason string, score double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    pixels = {i: np.random.default_rng(i).integers(0, 256, (50, 60, 3)).astype(np.uint8) for i, *_ in images}
    pictures = spark.createDataFrame([(i, 60, 50, 3, "uint8", bytearray(p.tobytes())) for i, p in pixels.items()], rasters.RASTER.format(id="bigint"))
    listing = spark.createDataFrame(images, "image_id bigint, group_id string, width int, height int")
    policy = CropPolicy(2.0, 8, 32, 24)
    made = confirmer.write_dataset(labelled, listing, pictures, f"{tmp_path}/d", policy).collect()
    kept = {x[1]: x for x in rows if x[3] != "duplicate_main"}
    assert {m["ord"] for m in made} == set(kept)
    by = {s: sorted((m for m in made if m["split"] == s), key=lambda m: m["number"]) for s in ("train", "holdout")}
    assert not {m["group_id"] for m in by["train"]} & {m["group_id"] for m in by["holdout"]}
    content = {x["crop"]: bytes(x["content"]) for x in spark.read.parquet(f"file://{tmp_path}/d/crops").collect()}
    assert len(content) == len(made)
    for split, mine in by.items():
        assert [m["number"] for m in mine] == list(range(1, len(mine) + 1)) and {m["label"] for m in mine} == {0, 1}
        assert [(m["group_id"], m["image_id"], m["ord"]) for m in mine] == sorted((m["group_id"], m["image_id"], m["ord"]) for m in mine)
        lines = [json.loads(x) for p in sorted(glob.glob(f"{tmp_path}/d/manifests/{split}.jsonl/part-*")) for x in open(p)]
        assert [x["crop"] for x in lines] == [f"crops/{split}/{k:06}.png" for k in range(1, len(mine) + 1)] and lines[0]["width_norm"] == pytest.approx(8 / 60)
    for m in made[:10]:
        box = kept[m["ord"]][5:]
        assert (rasters.decode_png(content[m["crop"]]) == confirmer.crop(pixels[m["image_id"]], box, policy)).all()
    with open(f"{tmp_path}/d/reports/dataset.json") as f:
        report = json.load(f)
    assert report["train"]["examples"] + report["holdout"]["examples"] == len(made) and report["policy"]["seed"] == 42
