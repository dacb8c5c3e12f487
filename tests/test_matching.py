import random

import pytest

from pyspark.sql import functions as F

from boxwright.operators import folds, matching, metrics
from tests.helpers import UNIT, counts, detections, truths


def test_keys_differ(spark):
    r = metrics.evaluate(detections(spark, [(1, 4, 0.9, UNIT)]), truths(spark, [(1, 0, UNIT)]))
    assert counts(r, "overall", "all") == (1, 0, 0)
    assert counts(r, "coarse", "ship") == (0, 0, 1)
    assert counts(r, "coarse", "aircraft") == (0, 1, 0)


def test_fine_classes(spark):
    r = metrics.evaluate(detections(spark, [(1, 8, 0.9, UNIT)]), truths(spark, [(1, 4, UNIT)]))
    assert counts(r, "coarse", "aircraft") == (1, 0, 0)
    assert counts(r, "fine", "4") == (0, 0, 1)
    assert counts(r, "fine", "8") == (0, 1, 0)


@pytest.mark.parametrize(("cls", "width", "tp"), [(0, 5.0, 1), (1, 5.0, 1), (2, 3.5, 1), (2, 3.49, 0)])
def test_bounds_are_closed(spark, cls, width, tp):
    r = metrics.evaluate(detections(spark, [(1, cls, 0.9, (0, 0, width, 10))]), truths(spark, [(1, cls, UNIT)]), "legacy3")
    assert counts(r, "overall", "all")[0] == tp


def test_duplicates(spark):
    r = metrics.evaluate(detections(spark, [(1, 0, 0.8, UNIT), (1, 0, 0.9, UNIT)]), truths(spark, [(1, 0, UNIT)]))
    row = r.where("scope = 'overall'").first()
    assert (row["tp"], row["fp"], row["fn"], row["recall"], row["fdr"]) == (1, 1, 0, 1.0, 0.5)


def test_difficult_and_empty(spark):
    r = metrics.evaluate(detections(spark, []), truths(spark, [(1, 0, UNIT, True)]), "legacy3")
    assert counts(r, "overall", "all") == (0, 0, 0)
    assert r.where("scope = 'image'").count() == 0
    assert {x["key"] for x in r.where("scope = 'fine'").collect()} == {"0", "1", "2"}


def test_false_positive_sources(spark):
    d = detections(spark, [(1, 0, 0.95, UNIT), (1, 0, 0.90, UNIT), (1, 0, 0.80, (50, 50, 60, 60))])
    audit = {r["coarse"]: (r["overlap"], r["background"], r["total"]) for r in metrics.false_positive_audit(d, truths(spark, [(1, 0, UNIT)])).collect()}
    assert audit == {"ship": (1, 1, 2), "aircraft": (0, 0, 0), "vehicle": (0, 0, 0)}


def test_sweep_keeps_order(spark):
    d = detections(spark, [(1, 0, 0.9, UNIT), (1, 0, 0.5, (50, 50, 60, 60))])
    rows = metrics.sweep(d, truths(spark, [(1, 0, UNIT)]), [0.9, 0.5, 1.0]).orderBy("place").collect()
    assert [(r["tp"], r["fp"], r["fn"]) for r in rows] == [(1, 0, 0), (1, 1, 0), (0, 0, 1)]


def test_proposals(spark):
    at = lambda x: (x, 0, x + 10, 10)
    main = detections(spark, [(1, 24, 0.95, at(0))])
    proposals = detections(spark, [(1, 24, 0.9, at(0)), (1, 24, 0.8, at(30)), (1, 24, 0.7, at(30)), (1, 24, 0.6, at(70))])
    rows = matching.label_proposals(main, proposals, truths(spark, [(1, 24, at(0)), (1, 24, at(30))])).orderBy("ord").collect()
    assert [r["reason"] for r in rows] == ["duplicate_main", "recoverable_truth", "duplicate_proposal", "background"]


def test_matching_against_loops(spark):
    r = random.Random(3)
    box = lambda: (lambda x, y: (x, y, x + r.randint(5, 12), y + r.randint(5, 12)))(r.randint(0, 25), r.randint(0, 25))
    d = [(r.randint(0, 3), r.randint(0, 24), r.randint(0, 9) / 10, box()) for _ in range(160)]
    t = [(r.randint(0, 3), r.randint(0, 24), box()) for _ in range(80)]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    want, free = set(), set(range(len(t)))
    for i in sorted(range(len(d)), key=lambda i: (-d[i][2], i)):
        best, at = 0.0, None
        for j in sorted(free):
            v = iou(d[i][3], t[j][2]) if d[i][0] == t[j][0] else 0
            if v >= (0.35 if t[j][1] == 24 else 0.5) and v > best:
                best, at = v, j
        if at is not None:
            free.discard(at)
            want.add((i, at))
    ds, ts = detections(spark, d), truths(spark, t)
    assert len(want) > 5
    got = {(x["p_ord"], x["t_ord"]) for x in matching.greedy_match(ds, ts, ("all",)).collect()}
    assert got == want
    # the walk goes on over the batches of a partition
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(x["p_ord"], x["t_ord"]) for x in matching.greedy_match(ds, ts, ("all",)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hamming_pairs(spark):
    rows = [("a", "g1", "0" * 16), ("b", "g2", "0" * 14 + "3f"), ("c", "g3", "0" * 14 + "7f"), ("d", "g1", "0" * 16)]
    found = {(r["left"], r["right"]) for r in matching.hamming_pairs(spark.createDataFrame(rows, "stem string, group_id string, phash string")).collect()}
    assert found == {("a", "b"), ("b", "c"), ("b", "d")}


def test_perfect_average_precision(spark):
    boxes = [(1, 0, UNIT), (2, 0, (5, 5, 20, 20)), (3, 0, (1, 1, 9, 9))]
    ap = metrics.average_precision(detections(spark, [(i, c, 0.9, b) for i, c, b in boxes]), truths(spark, boxes))
    row = metrics.mean_average_precision(ap).first()
    assert row["map50"] == pytest.approx(0.995) and row["map50_95"] == pytest.approx(0.995)


def test_average_precision_detection_limit(spark):
    d = detections(spark, [(1, 1, 0.95, UNIT), (1, 0, 0.90, UNIT)])
    t = truths(spark, [(1, 0, UNIT)])
    assert metrics.average_precision(d, t, 1, [0.5]).first()["ap"] == 0
    assert metrics.average_precision(d, t, 300, [0.5]).first()["ap"] > 0.9


def test_average_precision_duplicate_truth(spark):
    t = truths(spark, [(1, 0, UNIT), (1, 0, UNIT)])
    d = detections(spark, [(1, 0, 0.9, UNIT)])
    assert metrics.average_precision(d, t, dedupe=True, thresholds=[0.5]).first()["truths"] == 1
    assert metrics.average_precision(d, t, dedupe=False, thresholds=[0.5]).first()["truths"] == 2


def test_ids_by_name_are_gapless_at_any_size(spark):
    from boxwright.operators import curation

    n = 400_000
    names = spark.range(n).select(F.format_string("stem%09d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("stem"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "5")
    try:
        got = curation.ids_by_name(names.repartition(16), "stem")
        row = got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"), F.sum((F.col("id") - 1 == F.substring("stem", 5, 9).cast("bigint")).cast("int"))).first()
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    assert tuple(row) == (n, n, 1, n, n)


def test_hashes_within_a_family(spark):
    """Two families whose hashes come within six bits by chance stay apart where a common head is asked for (O12's SQL does)."""
    from boxwright.operators import curation

    rows = [(0, "a", "00000000000000" + "00"), (1, "b", "00000000000000" + "0f"), (2, "c", "00000000000001" + "00"), (3, "d", "00000000000001" + "01")]
    h = spark.createDataFrame(rows, "stem bigint, group_id string, phash string")
    pairs = lambda **k: {(r["left"], r["right"]) for r in matching.hamming_pairs(h, **k).collect()}
    assert (0, 2) in pairs() and pairs(within=F.substring("phash", 1, 14)) == {(0, 1), (2, 3)}
    groups = curation.duplicate_components(matching.hamming_pairs(h, within=F.substring("phash", 1, 14)), h)
    assert {r["stem"]: r["canonical"] for r in groups.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_two_models_are_matched_once(spark):
    """One walk for both models, and truths found by both, either or none."""
    rows = [("a", 1, 0, 0, 0.9, UNIT), ("b", 1, 0, 1, 0.8, UNIT), ("a", 1, 4, 2, 0.7, UNIT), ("b", 2, 4, 3, 0.7, UNIT), ("c", 2, 0, 4, 0.9, UNIT)]
    models = spark.createDataFrame([(m, i, c, o, s, *b) for m, i, c, o, s, b in rows], "model string, image_id bigint, class_id int, ord bigint, score double, x1 double, y1 double, x2 double, y2 double")
    t = truths(spark, [(1, 0, UNIT), (1, 4, UNIT), (2, 4, UNIT), (2, 0, UNIT), (2, 24, UNIT)])
    found = metrics.complementarity(models, t, "a", "b")
    assert {r["coarse"]: tuple(r)[1:6] for r in found.collect()} == {"ship": (1, 0, 0, 1, 2), "aircraft": (0, 1, 1, 2, 2), "vehicle": (0, 0, 0, 0, 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_walk_over_many_batches_and_keys(spark):
    """Keys with fields and nulls, groups that end within and across batches."""
    r = random.Random(3)
    rows = [((r.choice(["a", None]), k // 50), r.choice(["x", "y", None]), r.randint(0, 6), r.randint(0, 6), r.random(), k) for k in range(600)]
    edges = spark.createDataFrame(rows, "g struct<m: string, i: bigint>, key string, p bigint, t bigint, s double, n bigint")
    want, taken = set(), {}
    for g, key, p, t, s, n in sorted(rows, key=lambda x: (-x[4], x[5])):
        ends = taken.setdefault((g, key), (set(), set()))
        if p not in ends[0] and t not in ends[1]:
            ends[0].add(p)
            ends[1].add(t)
            want.add(n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {x["n"] for x in folds.one_to_one(edges, ["g", "key"], [F.desc("s"), F.col("n")], "p", "t").collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_consensus_shares_its_joins(spark, monkeypatch):
    """As each model labelled for itself, with a box join for the main model's claims, duplicates, the rest's claims and the agreement."""
    r = random.Random(11)
    box = lambda: (lambda x, y: (x, y, x + 10, y + 10))(r.randint(0, 40), r.randint(0, 40))
    main, first, second = (detections(spark, [(r.randint(0, 2), 24, r.randint(0, 9) / 10, box()) for _ in range(n)]) for n in (12, 40, 40))
    truth = truths(spark, [(r.randint(0, 2), 24, box(), r.random() < 0.1) for _ in range(40)])
    a, b = (matching.label_proposals(main, p, truth).where("reason <> 'duplicate_main'") for p in (first, second))
    want = matching.first_fit_pairs(a, b, 0.35).join(a.select("image_id", F.col("ord").alias("l_ord"), "label"), ["image_id", "l_ord"]).collect()
    joins = []
    monkeypatch.setattr(matching.spatial, "overlapping_pairs", lambda *a, f=matching.spatial.overlapping_pairs, **k: joins.append(1) or f(*a, **k))
    got = matching.consensus(main, first, second, truth)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(joins) == 4
    assert {x["label"] for x in got.collect()} == {0, 1}


def test_reports_above_are_one_matching(spark, monkeypatch):
    r = random.Random(12)
    box = lambda: (lambda x, y: (x, y, x + r.randint(8, 10), y + 10))(r.randint(0, 15), r.randint(0, 15))
    d = detections(spark, [(r.randint(0, 2), r.randint(0, 4), r.randint(0, 9) / 10, box()) for _ in range(120)])
    t = truths(spark, [(r.randint(0, 2), r.randint(0, 4), box(), r.random() < 0.1) for _ in range(60)])
    want = [metrics.evaluate(x, t).where("scope <> 'image'") for x in (d, d.where("score >= 0.5"))]
    want = [sorted(map(tuple, x.collect())) for x in want]
    made = []
    monkeypatch.setattr(metrics.matching, "greedy_match", lambda *a, f=matching.greedy_match, **k: made.append(1) or f(*a, **k))
    got = metrics.reports_above(d, t, (None, 0.5))
    assert [sorted(map(tuple, x.collect())) for x in got] == want and want[0] != want[1] and len(made) == 1
    (fine,) = metrics.reports_above(d, t, (0.5,), keys=("fine",))
    assert sorted(map(tuple, fine.collect())) == [x for x in want[1] if x[0] == "fine"]
