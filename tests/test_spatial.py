"""The cell join against all pairs: sizes far apart, corners on cell borders, reversed and empty boxes."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from boxwright.operators import kernels, matching, spatial
from tests.helpers import detections, truths


def iou(a, b):
    a, b = ((min(p[0], p[2]), min(p[1], p[3]), max(p[0], p[2]), max(p[1], p[3])) for p in (a, b))
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def boxes(seed, n=120):
    r, out = random.Random(seed), []
    for k in range(n):
        side = r.choice([0.01, 1, 4, 16, 16, 20, 64, 300, 1024])
        x, y = (r.choice([r.uniform(-200, 200), 16.0 * r.randint(-9, 9), 4.0 * r.randint(-30, 30)]) for _ in "xy")
        b = (x, y, x + side * r.choice([1, 1, 0.3]), y + side)
        out.append((k, r.randint(1, 2), b if r.random() < 0.9 else (b[2], b[1], b[0], b[3])))
    return out + [(n, 1, (5.0, 5.0, 5.0, 9.0)), (n + 1, 1, (math.nan, 0, 1, 1)), (n + 2, 1, (0, 0, math.inf, 1)), (n + 3, 2, (-1e6, -1e6, 1e6, 1e6))]


COLUMNS = "ord bigint, image_id bigint, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs_that_share_area(spark, seed):
    left, right = boxes(seed), boxes(seed + 50)
    frame = lambda rows: spark.createDataFrame([(k, im, *map(float, b)) for k, im, b in rows], COLUMNS)
    want = {(a[0], b[0]): iou(a[2], b[2]) for a, b in itertools.product(left, right) if a[1] == b[1] and all(map(math.isfinite, a[2] + b[2])) and iou(a[2], b[2]) > 0}
    rows = spatial.overlapping_pairs(frame(left), frame(right), ["image_id"], (["ord"], ["ord"])).collect()
    assert len(rows) == len(want) and {(r["l"]["ord"], r["r"]["ord"]): r["iou"] for r in rows} == pytest.approx(want) and len(want) > 500


def test_at_no_bound_every_pair_counts(spark):
    d, t = detections(spark, [(1, 0, 0.9, (0, 0, 1, 1)), (2, 0, 0.9, (0, 0, 1, 1))]), truths(spark, [(1, 0, (5, 5, 6, 6)), (1, 4, (0, 0, 1, 1))])
    assert spatial.pairs_at(d, t, ["image_id"], 0.0).count() == 2
    assert matching.greedy_match(d, t, ("all",), iou=0.0).select("p_ord", "t_ord").collect() == [(0, 1)]


def test_keys_of_one_pair(spark):
    """Each keying has the pairs of its own equi-join."""
    r = random.Random(9)
    at = lambda: (x := r.uniform(0, 60), y := r.uniform(0, 60), x + 20, y + 20)
    d = detections(spark, [(k % 2, r.choice([0, 1, 4, 24, 99]), r.random(), at()) for k in range(60)])
    t = truths(spark, [(k % 2, r.choice([0, 1, 4, 24, 99]), at()) for k in range(60)])
    for keys in (("all", "coarse", "fine"), ("coarse",), ("fine",), ("coarse", "fine")):
        got = matching.candidate_edges(d, t, keys)
        for key in keys:
            one = {"all": lambda c: 0, "coarse": lambda c: 0 if c <= 3 else 1 if c <= 23 else 2 if c == 24 else None, "fine": lambda c: c}[key]
            want = {(p["ord"], q["ord"]) for p in d.collect() for q in t.collect() if p["image_id"] == q["image_id"] and one(p["class_id"]) is not None and one(p["class_id"]) == one(q["class_id"])
                    and iou(tuple(p)[4:8], tuple(q)[3:7]) >= (0.35 if q["class_id"] == 24 else 0.5)}
            assert {(e["p_ord"], e["t_ord"]) for e in got.where(F.col("scope") == key).collect()} == want, keys


@pytest.mark.parametrize(("scale", "threshold"), [(2.0, 0.3), (0.5, 0.01), (5.0, 0.9), (1.0, 0.0), (1.0, 1.5)])
def test_dense_mask(spark, scale, threshold):
    r = random.Random(4)
    rows = [(1, 24, (x := r.uniform(0, 200), y := r.uniform(0, 200), x + r.uniform(1, 12), y + r.uniform(1, 12))) for _ in range(60)] + [(1, 0, (0, 0, 5, 5))]
    size = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])

    def near(a, b):
        (ax, ay, aw, ah), (bx, by, bw, bh) = size(a), size(b)
        apart = math.sqrt((aw - bw) ** 2 + (ah - bh) ** 2 + ((ax - bx) ** 2 + (ay - by) ** 2) / max(((aw + bw) / 2) ** 2 + ((ah + bh) / 2) ** 2, 1e-9))
        return math.exp(-apart / scale) > threshold

    want = {k for k, a in enumerate(rows) if a[1] == 24 and any(b[1] == 24 and j != k and near(a[2], b[2]) for j, b in enumerate(rows))}
    assert {x["ord"] for x in kernels.dense_mask(truths(spark, rows), scale, threshold).where("dense").collect()} == want


@pytest.mark.parametrize("least", [0.05, 0.35, 0.5, 0.9, 1.0])
def test_pairs_at_a_bound(spark, least):
    """No pair at the bound is lost, be it met exactly; boxes that overlap far less are not paired."""
    r = random.Random(8)
    left = [(k, 1, (x := r.choice([r.uniform(-200, 200), 16.0 * r.randint(-9, 9), 1e6]), y := r.uniform(-50, 50), x + r.choice([4, 16, 20, 64]), y + r.choice([4, 16, 20]))) for k in range(250)]
    moved = lambda b, dx, dy: (b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy)
    right = [(k, 1, moved(b, *r.choice([(0, 0), ((b[2] - b[0]) / 3, 0), (0, (b[3] - b[1]) / 3), (r.uniform(-9, 9), r.uniform(-9, 9)), (0, (b[3] - b[1]) * 0.65 / 1.35)]))) for k, _, b in left]
    frame = lambda rows: spark.createDataFrame([(k, im, *map(float, b)) for k, im, b in rows], COLUMNS)
    want = {(a[0], b[0]) for a in left for b in right if iou(a[2], b[2]) >= least}
    got = spatial.pairs_at(frame(left), frame(right), ["image_id"], least, (["ord"], ["ord"])).collect()
    assert len(got) == len(want) and {(x["l"]["ord"], x["r"]["ord"]) for x in got} == want and len(want) > 20


def test_cores_that_are_apart_are_not_paired(spark):
    frame = lambda x: spark.createDataFrame([(0, 1, x, 0.0, x + 20, 20.0)], COLUMNS)
    found = lambda *t: spatial.overlapping_pairs(frame(0.0), frame(15.0), ["image_id"], least=tuple(map(F.lit, t))).count()
    assert found(0.5, 0.5) == 0 and found(0.1, 0.1) == 1
