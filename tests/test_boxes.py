import math

import pytest
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import filters, inference, search, splitting, suppression
from tests.helpers import UNIT, detections


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(b):
    return [F.lit(float(v)) for v in b]


def outline(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_iou_cases(spark):
    assert value(spark, G.hbb_iou(lit((10, 10, 0, 0)), lit(UNIT))) == 1.0
    assert value(spark, G.hbb_iou(lit((0, 0, 0, 0)), lit((0, 0, 0, 0)))) == 0.0
    assert value(spark, G.hbb_iou(lit(UNIT), lit((0, 0, 3.5, 10)))) == 0.35


def test_rotated_squares(spark):
    square, turned = [(-1, -1), (1, -1), (1, 1), (-1, 1)], [(0, -math.sqrt(2)), (math.sqrt(2), 0), (0, math.sqrt(2)), (-math.sqrt(2), 0)]
    octagon = 8 * (math.sqrt(2) - 1)
    assert value(spark, G.polygon_iou(outline(square), outline(turned))) == pytest.approx(octagon / (8 - octagon))
    assert value(spark, G.polygon_iou(outline(square[::-1]), outline(turned))) == pytest.approx(octagon / (8 - octagon))


def test_bad_outlines(spark):
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    assert value(spark, G.polygon_iou(outline(bow), outline([(0, 0), (2, 0), (2, 2), (0, 2)]))) == 0.0
    far = [(10, 10), (12, 10), (12, 12), (10, 12)]
    assert value(spark, G.polygon_iou(outline(far), outline([(0, 0), (2, 0), (2, 2), (0, 2)]))) == 0.0


def test_distance_suppression(spark):
    d = detections(spark, [(1, 3, 0.95, UNIT), (1, 3, 0.90, (1, 0, 11, 10)), (1, 3, 0.80, (30, 0, 40, 10)), (1, 24, 0.7, UNIT), (1, 24, 0.6, UNIT)])
    rules = spark.createDataFrame([(3, "diou", 0.30)], "class_id int, method string, threshold double")
    assert sorted(r["score"] for r in suppression.suppress_classes(d, rules).collect()) == [0.6, 0.7, 0.80, 0.95]


def test_threshold_zero_keeps_the_first(spark):
    d = detections(spark, [(1, 3, 0.95, UNIT), (1, 3, 0.90, (90, 90, 95, 95))])
    rules = spark.createDataFrame([(3, "iou", 0.0)], "class_id int, method string, threshold double")
    assert suppression.suppress_classes(d, rules).count() == 1
    assert suppression.merge_detections(d, 0.0).count() == 2


def test_missing_threshold_raises(spark):
    d = detections(spark, [(1, 3, 0.95, UNIT)])
    none = spark.createDataFrame([], "class_id int, threshold double")
    assert filters.over_class_threshold(d, none).count() == 1
    assert filters.pipeline_filter(d, none).count() == 0
    with pytest.raises(Exception, match="no threshold"):
        suppression.fuse_multiscale(d, d, d, none, (0.5, 0.5), (0.5, 0.5), 0.5, 1.0).collect()


def test_multiscale_fusion(spark):
    d = detections(spark, [(1, 5, 0.9, UNIT), (1, 5, 0.3, (50, 50, 60, 60)), (1, 0, 0.8, UNIT), (1, 24, 0.4, UNIT), (1, 24, 0.4, (0, 0, 40, 40))])
    bounds = spark.createDataFrame([(5, 0.5), (0, 0.5), (24, 0.3)], "class_id int, threshold double")
    rows = suppression.fuse_multiscale(d, d, d, bounds, (0.25, 0.5), (0.5, 0.5), 0.5, 1000.0).collect()
    assert sorted(r["ord"] for r in rows) == [0, 1, 2, 4]


def test_tiles(spark):
    t = inference.tiles(spark.createDataFrame([(1, 50, 40), (2, 128, 64), (3, 129, 64)], "image_id bigint, width int, height int"), 64, 0.0)
    xs = {}
    for r in t.collect():
        xs.setdefault(r["image_id"], []).append(r["x"])
    assert {k: sorted(v) for k, v in xs.items()} == {1: [0], 2: [0, 64], 3: [0, 64, 65]}


def test_pipeline_with_one_box(spark):
    images = spark.createDataFrame([(1, 32, 32)], "image_id bigint, width int, height int")
    detector = lambda rows: [[{"class_id": 0, "score": 0.9, "box": (5.0, 5.0, 20.0, 20.0)}] for _ in rows]
    t = spark.createDataFrame([(0, 0.5)], "class_id int, threshold double")
    rows = inference.run_pipeline(images, detector, t, 64, 0.2, 2.0, 0.5).collect()
    assert [(r["x1"], r["y2"], r["score"]) for r in rows] == [(5.0, 20.0, 0.9)]


def test_batch_backoff():
    sizes = []

    def detector(rows):
        sizes.append(len(rows))
        if len(rows) > 2:
            raise MemoryError
        return [[r] for r in rows]

    assert inference.predict_with_backoff(detector, list(range(5)), 8) == ([[i] for i in range(5)], 2)
    assert sizes == [5, 4, 2, 2, 1] or sizes[-3:] == [2, 2, 1]


def test_choice_is_an_ordered_fold():
    same = search.Objective(5, 1, 1)
    assert search.select_best([(0.1, same), (0.2, same)], 0.0)[0] == 0.1
    better = search.Objective(6, 1, 0)
    assert search.select_best([(0.1, same), (0.2, better)], 0.0)[0] == 0.2
    low = search.Objective(1, 0, 5)
    assert search.select_best([(0.1, low), (0.2, same)], 0.5)[0] == 0.2


def test_folds_are_balanced_and_reproducible():
    vectors = {f"g{i}": {"images": 1 + i % 3, f"f{i % 4}": 2, "cship": 1} for i in range(30)}
    a = splitting.build_folds(vectors, 5)
    assert a == splitting.build_folds(dict(reversed(vectors.items())), 5)
    assert set(a.values()) == set(range(5))


def test_validation_covers_every_class():
    vectors = {f"g{i}": {"images": 2, f"f{i % 6}": 3, "cship": 3} for i in range(24)}
    chosen = splitting.select_validation(vectors, 0.25)
    held = {n for g in chosen for n in vectors[g] if n[0] == "f"}
    left = {n for g in set(vectors) - chosen for n in vectors[g] if n[0] == "f"}
    assert held == left == {f"f{i}" for i in range(6)}
    assert sum(vectors[g]["images"] for g in chosen) == 12


def test_any_group_may_be_held_out():
    labels = {f"g{i:02}": [0, 0] for i in range(14)} | {g: [1, 1, 1, 0, 0] for g in ("g12", "g13")}
    held = splitting.combination_split(labels, 0.2)
    assert len(held) == 3 and len(held & {"g12", "g13"}) == 1
    first = min(("g12", "g13"), key=lambda g: splitting.rank(42, g))
    rest = sorted(set(labels) - {"g12", "g13"}, key=lambda g: splitting.rank(42, g))
    assert held == {first, *rest[:2]}


def test_searches_run_by_the_operators_defaults(spark, monkeypatch):
    from boxwright.plans import datasets, registry

    asked = {}

    def note(name, give):
        def run(*a, **k):
            asked[name] = (a, k)
            return give

        return run

    class Counts:
        tp = fp = fn = 0

    monkeypatch.setattr(datasets, "view", lambda *a: spark.createDataFrame([(1,)], "class_id int"))
    monkeypatch.setattr(datasets, "_vectors", lambda *a: {})
    monkeypatch.setattr(search, "group_counts", lambda *a: [None])
    monkeypatch.setattr(search, "optimize_thresholds", note("O1", ({0: 0.2}, Counts)))
    monkeypatch.setattr(search, "optimize_ranking", note("O4", {0: 0.2}))
    monkeypatch.setattr(splitting, "select_validation", note("O14", set()))
    for name in ("O1", "O4", "O14"):
        registry.QUERIES[name](spark, "")
    assert not any({"passes", "rounds"} & set(k) for _, k in asked.values())
    assert asked["O1"][0][2] == [0.2, 0.4, 0.6] and asked["O4"][0][3] == datasets.GRID
