"""Searches pair the boxes once, however many maps they score."""

import pytest
from pyspark.sql import functions as F

from boxwright.operators import matching, search
from tests.helpers import UNIT, detections, truths


@pytest.fixture
def seen(monkeypatch):
    calls, plain = [], matching.candidate_edges
    monkeypatch.setattr(matching, "candidate_edges", lambda *a, **k: calls.append(1) or plain(*a, **k))
    return calls


def test_one_pairing(spark, seen):
    d = detections(spark, [(k, k % 3, s, UNIT if k % 4 else (40, 40, 50, 50)) for k in range(12) for s in (0.3, 0.9)])
    t = truths(spark, [(k, k % 3, UNIT) for k in range(12)])
    chosen, best = search.optimize_thresholds(d, t, [0.2, 0.5], 0.1, taxonomy="legacy3")
    assert len(seen) == 1 and chosen == dict.fromkeys(range(3), 0.5) and (best.tp, best.fp, best.fn) == (9, 3, 3)
    base = {n: search.Objective(3, 5, 1) for n in ("aircraft", "ship", "vehicle")}
    assert search.optimize_ranking(d, t, base, [0.2, 0.5], "legacy3") == dict.fromkeys(range(3), 0.5) and len(seen) == 4


def test_one_matching_of_a_calibration(spark, seen):
    d = detections(spark, [(k, 5, 0.1 + k % 9 / 10, UNIT if k % 4 else (40, 40, 50, 50)) for k in range(36)])
    t = truths(spark, [(k, 5, UNIT) for k in range(36)])
    folds = spark.range(36).select(F.col("id").alias("image_id"), (F.col("id") % 2).cast("int").alias("fold"))
    chosen, told = search.calibrate(d, t, folds, [0.35, 0.65], 0.15, 0.9, 0.9)
    assert len(seen) == 1 and {r["threshold"] for r in chosen.collect()} == {0.35} and told["threshold"] == 0.35
    search.calibrate(d, t, folds, [0.35, 0.65], 0.15, 0.9, 0.9, baseline_detections=d.where("image_id < 20"))
    assert len(seen) == 3


def test_fold_totals_hold_no_matching(spark):
    d, t = detections(spark, [(i, 0, 0.9, UNIT) for i in range(4)]), truths(spark, [(i, 0, UNIT) for i in range(3)])
    folds = spark.createDataFrame([(i, i % 2) for i in range(4)], "image_id bigint, fold int")
    totals = search.fold_totals(search.threshold_counts(d, t, [0.5]), folds, "threshold")
    assert "MapInArrow" not in totals._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in totals.collect()) == [(0, 0.5, 1, 1, 0, 2, 0, 0), (1, 0.5, 2, 0, 0, 1, 1, 0)]
