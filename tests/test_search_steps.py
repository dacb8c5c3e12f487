"""Steps of a threshold search walk pairs that are written once."""

import random

import pytest
from pyspark.sql import functions as F

from boxwright.operators import matching, search
from tests.helpers import detections, truths


def boxes(seed, images, n):
    r = random.Random(seed)
    box = lambda: (lambda x, y: (x, y, x + 10, y + 10))(r.randint(0, 6), r.randint(0, 6))
    d = [(r.choice(images), r.randint(0, 3), r.randint(0, 9) / 10, box()) for _ in range(n)]  # class 3 is none of the taxonomy's
    return d, [(r.choice(images), r.randint(0, 2), box(), r.random() < 0.1) for _ in range(n // 2)]


def plain(spark, d, t, grid, floor, passes):
    """The search as its rule says, one pair after the other."""
    score, group = {r["ord"]: r["score"] for r in d.collect()}, {r["ord"]: r["class_id"] for r in d.collect()}
    pairs = sorted(matching.candidate_edges(d, t, ("all",), "legacy3").collect(), key=lambda r: (-r["score"], r["p_ord"], -r["iou"], r["t_ord"]))
    n = t.where("not difficult").count()

    def count(m):
        kept = {o for o in score if group[o] in m and score[o] >= m[group[o]]}
        left, right = set(), set()
        for r in pairs:
            if r["p_ord"] in kept and r["p_ord"] not in left and r["t_ord"] not in right:
                left.add(r["p_ord"])
                right.add(r["t_ord"])
        return search.Objective(len(left), len(kept) - len(left), n - len(left))

    best_t, best = search.select_best([(v, count(dict.fromkeys(range(3), v))) for v in grid], floor)
    current = dict.fromkeys(range(3), best_t)
    for _ in range(passes):
        for c in range(3):
            v, o = search.select_best([(v, count(current | {c: v})) for v in grid], floor)
            if search.is_better(o, best):
                current, best = current | {c: v}, o
    return current, best


@pytest.mark.parametrize("piece", [7, 4096])
def test_search_is_the_plain_one(spark, monkeypatch, piece):
    """With images in one row, in many, and in exactly full ones."""
    monkeypatch.setattr(search, "PIECE", piece)
    d, t = boxes(piece, [0, 0, 0, *range(12)], 160)
    d, t = detections(spark, d), truths(spark, t)
    grid = [0.2, 0.5, 0.8]
    assert search.optimize_thresholds(d, t, grid, 0.1, "legacy3") == plain(spark, d, t, grid, 0.1, 2)


def test_steps_shuffle_no_pairs(spark):
    d, t = boxes(3, range(6), 240)
    d, t = detections(spark, d), truths(spark, t)
    pairs = matching.candidate_edges(d, t, ("all",), "legacy3").where(F.col("score") >= 0.2).count()
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled(passes):
        seen = lambda: {s.stageId(): s.shuffleWriteRecords() for found in [store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)] for s in map(found.apply, range(found.size()))}
        before = seen()
        search.optimize_thresholds(d, t, [0.2, 0.5, 0.8], 0.1, "legacy3", passes)
        return sum(n for k, n in seen().items() if k not in before)

    assert pairs > 1000 and shuffled(2) - shuffled(0) < pairs / 2
