"""Outlines against areas counted on a grid, and suppression against the plain walk."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxwright.operators import outlines as O

SQUARE = [(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)]


@pytest.mark.parametrize(
    ("p", "q", "iou"),
    [
        (SQUARE, SQUARE, 1.0),
        (SQUARE, SQUARE[::-1] + SQUARE[-1:], 1.0),
        ([(0, 0), (10, 0), (10, 10), (0, 10)], [(20, 20), (30, 20), (30, 30), (20, 30)], 0.0),
        ([(0, 0), (10, 10), (0, 10), (10, 0)], SQUARE, 0.0),  # bow tie
        ([(math.nan, 0), (10, 0), (10, 10), (0, 10)], SQUARE, 0.0),
        ([(0, 0), (10, 0), (20, 0)], SQUARE, 0.0),  # no area
        ([(10, 10), (20, 15), (30, 10), (20, 30)], SQUARE, 0.375),  # concave
        ([(20, 10), (30, 20), (20, 30), (10, 20)], SQUARE, 0.5),  # rotated
        ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 0), (2, 4), (0, 4)], SQUARE, 0.0),  # runs back over itself
        ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)], 0.0),  # touches itself
        ([(0, 0), (1, 0), (1, 3), (3, 3), (3, 0), (4, 0), (4, 4), (0, 4)], [(1, 0), (3, 0), (3, 3), (1, 3)], 0.0),  # in the notch
        ([(0, 0), (1, 0), (1, 3), (3, 3), (3, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)], 10 / 16),
    ],
)
def test_known(p, q, iou):
    assert O.outline_iou(np.array(p), np.array(q)) == pytest.approx(iou) == O.outline_iou(np.array(q), np.array(p))


def star(r, n=9):
    """A simple outline: corners by angle around a centre."""
    x, y, angles = r.uniform(20, 40), r.uniform(20, 40), sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return np.array([(x + d * math.cos(a), y + d * math.sin(a)) for a in angles for d in [r.uniform(5, 18)]])


def inside(p, x, y):
    found = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0)):
        found ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) / (by - ay) * (bx - ax))
    return found


def test_against_counted_points():
    r, axis = random.Random(7), (np.arange(1200) + 0.5) / 20
    x, y = np.meshgrid(axis, axis)
    seen = 0
    for _ in range(25):
        p, q = star(r), star(r)
        if not (O.is_simple(p) and O.is_simple(q)):
            continue
        a, b = inside(p, x, y), inside(q, x, y)
        assert O.outline_iou(p, q) == pytest.approx((a & b).sum() / (a | b).sum(), abs=5e-3)
        seen += 1
    assert seen > 15


def test_rows_together():
    """Pairs of many shapes at once: as pair by pair, null and empty outlines, repeated corners and slices of a column included."""
    r = random.Random(11)
    shapes = [None, [], SQUARE, SQUARE + SQUARE[:1], [(0, 0), (10, 10), (0, 10), (10, 0)], [(math.nan, 0), (10, 0), (10, 10)], [(0, 0), (10, 0), (20, 0)], [(0, 0), (4, 0), (4, 4), (2, 4), (2, 0), (2, 4), (0, 4)]]
    shapes += [star(r, n).tolist() for n in (3, 4, 6, 9) for _ in range(12)]
    pairs = [(p, q) for p in shapes for q in shapes]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    p, q = (pa.array([None if v is None else [{"x": x, "y": y} for x, y in v] for v in side], kind) for side in zip(*pairs))
    plain = np.array([0.0 if a is None or b is None else O.outline_iou(np.array(a), np.array(b)) for a, b in pairs])
    assert np.allclose(O.outline_ious(p, q), plain, rtol=0, atol=1e-12) and (plain > 0.1).sum() > 200
    assert np.allclose(O.outline_ious(p[100:], q[100:]), plain[100:], rtol=0, atol=1e-12)
    bounded = O.outline_ious(p, q, 0.3)
    assert np.allclose(bounded[plain >= 0.3], plain[plain >= 0.3], rtol=0, atol=1e-12) and (bounded[plain < 0.3] < 0.3).all()


def test_suppression(spark):
    r = random.Random(3)
    rows = [(k % 3, k % 2, k, round(r.random(), 1), star(r).tolist()) for k in range(60)]
    df = spark.createDataFrame([(im, c, o, s, [tuple(p) for p in poly]) for im, c, o, s, poly in rows], "image_id bigint, class_id int, ord bigint, score double, polygon array<struct<x:double,y:double>>")
    kept = []
    for row in sorted(rows, key=lambda x: (-x[3], x[2])):
        clash = [O.outline_iou(np.array(row[4]), np.array(k[4])) for k in kept if k[:2] == row[:2]]
        if not any(v > 0 and v >= 0.3 for v in clash):
            kept.append(row)
    got = {x["ord"] for x in O.suppress_outlines(df.repartition(4), 0.3).collect()}
    assert got == {k[2] for k in kept} and 5 < len(got) < 60


def test_null_outlines(spark):
    df = spark.range(1).select(F.lit(None).cast("array<struct<x:double,y:double>>").alias("p"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).alias("q"))
    assert O.with_iou(df, "p", "q").first()["iou"] == 0.0


def test_boxes_as_outlines(spark):
    """Suppression of boxes by their outlines is that of the boxes, in plans that fold no pair in an expression; rows without an image stay."""
    from boxwright.operators import suppression
    from tests.helpers import detections

    r = random.Random(8)
    boxes = [(x, y, x + r.randint(5, 20), y + r.randint(5, 20)) for x, y in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(80))]
    d = detections(spark, [(k % 3, k % 2, r.randint(0, 9) / 10, b if k % 7 else (*b[2:], *b[:2])) for k, b in enumerate(boxes)])
    whole = lambda df: sorted(map(tuple, df.collect()))
    found = suppression.merge_detections(d, 0.2037, polygons=True)
    assert whole(found) == whole(suppression.merge_detections(d, 0.2037)) and 10 < found.count() < 80
    assert "aggregate(items" not in found._jdf.queryExecution().optimizedPlan().toString()
    lost = d.withColumn("image_id", F.lit(None).cast("bigint"))
    assert suppression.merge_detections(lost, 0.2037, polygons=True).count() == 80
