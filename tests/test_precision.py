"""Average precision, precision and recall against a plain version with numpy's interpolation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.operators import metrics
from tests.helpers import detections, truths


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def plain(dets, gts, most=300):
    """dets: (image, class, score, box), gts: (image, class, box) -> per class precision, recall, f1, ap at each threshold."""
    levels, rows = metrics.AP_THRESHOLDS, []
    for image in sorted({d[0] for d in dets} | {g[0] for g in gts}):
        mine = sorted((d for d in dets if d[0] == image), key=lambda d: -d[2])[:most]
        theirs = [g for g in gts if g[0] == image]
        for level in range(len(levels)):
            best = {}
            for i, d in enumerate(mine):
                found = [(iou(d[3], g[2]), -j) for j, g in enumerate(theirs) if g[1] == d[1] and iou(d[3], g[2]) >= levels[level]]
                if found:
                    best.setdefault(-max(found)[1], i)  # a truth takes the first of those whose best it is
            rows += [(image, i, d[1], d[2], level, i in best.values()) for i, d in enumerate(mine)]
    classes, x, out = sorted({g[1] for g in gts}), np.linspace(0, 1, 1000), {}
    for c in classes:
        n, ap, curves = sum(g[1] == c for g in gts), [], (np.zeros(1000), np.zeros(1000))
        for level in range(len(levels)):
            mine = sorted(((-s, image, i, hit) for image, i, k, s, v, hit in rows if k == c and v == level))
            if not mine:
                ap.append(0.0)
                continue
            score, hit = np.array([-m[0] for m in mine]), np.array([m[3] for m in mine], float)
            r, p = hit.cumsum() / n, hit.cumsum() / np.arange(1, len(hit) + 1)
            if level == 0:
                curves = np.interp(-x, -score, p, left=1), np.interp(-x, -score, r, left=0)
            mrec, mpre = np.concatenate([[0.0], r, [r[-1], 1.0]]), np.concatenate([[1.0], p, [0.0, 0.0]])
            mpre = np.flip(np.maximum.accumulate(np.flip(mpre)))
            grid = np.linspace(0, 1, 101)
            ap.append(np.trapezoid(np.interp(grid, mrec, mpre), grid))
        out[c] = (*curves, ap)
    f1 = {c: 2 * p * r / (p + r + 1e-16) for c, (p, r, _) in out.items()}
    mean = np.mean(list(f1.values()), axis=0)
    half = (round(1000 * 0.1 * 2) // 2 + 1) // 2
    smooth = np.convolve(np.concatenate([mean[0] * np.ones(half), mean, mean[-1] * np.ones(half)]), np.ones(2 * half + 1) / (2 * half + 1), mode="valid")
    at = int(np.round(smooth, 12).argmax())
    return {c: (p[at], r[at], f1[c][at], ap) for c, (p, r, ap) in out.items()}


def scene(seed, images=12, ties=True):
    r, dets, gts = random.Random(seed), [], []
    for image in range(images):
        for _ in range(r.randint(0, 9)):
            x, y, c = r.uniform(0, 90), r.uniform(0, 90), r.choice([0, 4, 4, 24])
            gts.append((image, c, (x, y, x + 20, y + 20)))
            for _ in range(r.randint(0, 3)):
                dx, dy = r.uniform(-6, 6), r.uniform(-6, 6)
                dets.append((image, r.choice([c, c, c, 7]), round(r.random(), 1 if ties else 6), (x + dx, y + dy, x + dx + 20, y + dy + 20)))
    return dets, gts


@pytest.mark.parametrize("seed,ties", [(1, True), (2, False), (3, True)])
def test_against_numpy(spark, seed, ties):
    dets, gts = scene(seed, ties=ties)
    want = plain(dets, gts)
    got = {r["class_id"]: r for r in metrics.detection_metrics(detections(spark, dets), truths(spark, gts)).collect()}
    assert set(got) == set(want)
    for c, (p, r, f1, ap) in want.items():
        assert (got[c]["precision"], got[c]["recall"], got[c]["f1"], got[c]["ap50"], got[c]["ap50_95"]) == pytest.approx((p, r, f1, ap[0], np.mean(ap)), abs=1e-9)


def test_a_class_over_many_ranges(spark):
    """Ranks and sums go on from range to range."""
    n = 5000
    df = spark.range(n).select((F.col("id") % 2).alias("c"), ((F.col("id") * 7919) % n).alias("s"), "id", (F.col("id") % 3 == 0).cast("bigint").alias("y")).repartition(7)
    rows = metrics.ranked_in_ranges(df, "c", [F.desc("s"), F.col("id")], ["y"]).collect()
    assert len({r["k"] for r in rows if r["c"] == 0}) == n // 2
    for c in (0, 1):
        mine, tp = sorted((r for r in rows if r["c"] == c), key=lambda r: -r["s"]), 0
        for k, r in enumerate(mine, 1):
            tp += r["id"] % 3 == 0
            assert (r["k"], r["y"]) == (k, tp)


def test_perfect(spark):
    boxes = [("a", 4, (0, 0, 10, 10)), ("s", 0, (20, 20, 30, 30)), ("v", 24, (40, 40, 50, 50))]
    at = {"a": 1, "s": 2, "v": 3}
    d, t = detections(spark, [(at[i], c, 0.9, b) for i, c, b in boxes]), truths(spark, [(at[i], c, b) for i, c, b in boxes])
    m = metrics.mean_detection_metrics(metrics.detection_metrics(d, t)).first()
    assert tuple(m) == pytest.approx((1.0, 1.0, 0.995, 0.995))


def test_limit_duplicates_and_nothing(spark):
    unit = (0, 0, 10, 10)
    d, t = detections(spark, [(1, 5, 0.95, unit), (1, 4, 0.90, unit)]), truths(spark, [(1, 4, unit)])
    recall = lambda *a, **k: metrics.detection_metrics(*a, **k).first()["recall"]
    assert recall(d, t, max_detections=1) == 0.0 and recall(d, t) == pytest.approx(1.0)
    d, t = detections(spark, [(1, 24, 0.9, unit)]), truths(spark, [(1, 24, unit), (1, 24, unit)])
    assert recall(d, t) == pytest.approx(1.0) and recall(d, t, dedupe=False) < 1.0
    with pytest.raises(ValueError):
        metrics.detection_metrics(d, truths(spark, [(1, 24, unit, True)]))
    nothing = metrics.detection_metrics(detections(spark, []), truths(spark, [(1, 24, unit)])).first()
    assert (nothing["precision"], nothing["recall"], nothing["ap50"]) == (0.0, 0.0, 0.0)


def test_binary_average_precision_without_keys(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.1, 0)], "id int, score double, y int")
    assert metrics.binary_average_precision(df, "score", "y", "id").first()["ap"] == pytest.approx((1 + 2 / 3) / 2)
