import json
import zipfile

import pytest
from pyspark.sql import functions as F

from boxwright.functions import scalar as S
from boxwright.operators import curation, metrics
from boxwright.sources import readers, sinks
from tests.helpers import UNIT, detections, truths


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, value string")


def test_prediction_keys_are_exact(spark):
    good = {"image_id": 7, "category_id": 1, "bbox": [1.0, 2.0, 3.0, 4.0], "score": 0.5}
    row = readers.coco_predictions(files(spark, json.dumps([good]))).first()
    assert (row["image_id"], row["x2"], row["y2"], row["ord"]) == ("7", 4.0, 6.0, 0)
    for bad in (good | {"extra": 1}, {k: v for k, v in good.items() if k != "score"}, good | {"score": 1.5}, good | {"bbox": [0, 0, 0, 1]}, good | {"category_id": 25}):
        with pytest.raises(Exception, match="prediction"):
            readers.coco_predictions(files(spark, json.dumps([bad]))).collect()


def test_yolo_lines(spark):
    row = readers.yolo_boxes(files(spark, "3 0.5 0.5 1.0000001 0.5\n", "")).collect()
    assert len(row) == 1 and (row[0]["x1"], row[0]["x2"]) == (0.0, 1.0)
    with pytest.raises(Exception, match="f0:2"):
        readers.yolo_boxes(files(spark, "3 0.5 0.5 0.5 0.5\n\n3 0.5 0.5 0.5 0.5")).collect()


def test_dota_lines(spark):
    text = "imagesource:GoogleEarth\ngsd:0.1\n0 0 1 0 1 1 0 1 large vehicle 1\n0 0 1 0 1 1 0 1 ship\nshort line\n0 0 1 0 1 1 0 1 spaceship 0"
    rows = readers.dota_boxes(files(spark, text), {"vehicle": 0, "large vehicle": 1, "ship": 2}).orderBy("ord").collect()
    assert [(r["class_id"], r["difficult"]) for r in rows] == [(1, True), (2, False), (None, False)]


def test_pairs_are_checked(spark):
    stems = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    frame = lambda *p: spark.createDataFrame(p, "left string, right string")
    assert readers.duplicate_pairs(frame((" a", "b ")), stems).first() == ("a", "b")
    for bad in ((("a", "a"),), (("a", "b"), ("b", "a")), (("a", "z"),)):
        with pytest.raises(Exception, match="bad pair"):
            readers.duplicate_pairs(frame(*bad), stems).collect()


def test_archive(tmp_path):
    import hashlib

    path = tmp_path / "r.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("root/images/val/s.jpg", b"pixels")
        z.writestr("root/labels/val/s.txt", "0 .5 .5 .1 .1")
    digest = hashlib.sha256(b"pixels").hexdigest()
    assert readers.reviewed_archive(str(path), {"s": digest}) == {"s": "0 .5 .5 .1 .1"}
    with pytest.raises(ValueError, match="differ"):
        readers.reviewed_archive(str(path), {"s": "0"})
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="refused"):
        readers.reviewed_archive(str(path), {"s": digest})


def test_export(spark, tmp_path):
    ids = spark.createDataFrame([(1, 100)], "stem bigint, id bigint")
    rows = sinks.coco_rows(detections(spark, [(1, 0, 0.9, UNIT), (1, 0, 0.8, UNIT)]), ids)
    assert [r["fault"] for r in sinks.check_coco(rows, ids).collect()] == ["duplicate box"] * 2
    sinks.export_coco(rows, str(tmp_path / "o.json"))
    assert [r["score"] for r in json.loads((tmp_path / "o.json").read_text())] == [0.9, 0.8]
    with pytest.raises(Exception, match="no id"):
        sinks.coco_rows(detections(spark, [(2, 0, 0.9, UNIT)]), ids).collect()


def test_report_round_trip(spark):
    report = metrics.evaluate(detections(spark, [(1, 0, 0.9, UNIT)]), truths(spark, [(1, 0, UNIT)]))
    again = readers.report_json(sinks.report_document(report), slack=1e-6)
    assert {tuple(r) for r in again.select(*report.columns).collect()} == {tuple(r) for r in report.collect()}


def test_publish_rolls_back(tmp_path):
    old, stage = tmp_path / "data", tmp_path / "stage"
    for p, text in ((old, "old"), (stage, "new")):
        p.mkdir()
        (p / "f").write_text(text)
    (old / sinks.MARKER).touch()

    def fail(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.publish(str(stage), str(old), fail)
    assert (old / "f").read_text() == "old"
    stage.mkdir()
    (stage / "f").write_text("new")
    sinks.publish(str(stage), str(old), lambda p: None)
    assert (old / "f").read_text() == "new"


def test_artifacts_only_if_passed(tmp_path):
    assert sinks.write_artifacts(str(tmp_path), {"a.json": {"x": 1}, "c.yaml": {"t": 1}}, passed=False, only_if_passed=("c.yaml",)) == ["a.json"]
    assert "c.yaml" in sinks.write_artifacts(str(tmp_path), {"c.yaml": {"t": 1}}, passed=True, only_if_passed=("c.yaml",))
    assert readers.yaml_config((tmp_path / "c.yaml").read_text(), {"t"}) == {"t": 1}
    with pytest.raises(ValueError):
        readers.yaml_config("u: 1", {"t"})


def test_named_specs():
    assert readers.parse_named(["a=x", "b=y"]) == {"a": "x", "b": "y"}
    with pytest.raises(ValueError):
        readers.parse_named(["a=x", "a=y"])


def test_quota_orders_differ(spark):
    rows = [(1, 0, 0.9, UNIT), (1, 0, 0.8, (20, 20, 30, 30)), (1, 0, 0.7, (50, 50, 60, 60))]
    t = truths(spark, [(1, 0, (5, 5, 8, 8))])
    order = [-F.col("score"), F.col("ord")]
    before = curation.quota_then_reject(detections(spark, rows), t, ["image_id"], order, 2)
    after = curation.reject_then_quota(detections(spark, rows), t, ["image_id"], order, 2)
    assert sorted(r["ord"] for r in before.collect()) == [1] and sorted(r["ord"] for r in after.collect()) == [1, 2]


def test_expert_crops_fill_up(spark):
    t = truths(spark, [(1, 24, UNIT), (1, 24, (70, 70, 80, 80))])
    images = spark.createDataFrame([(i, f"s{i}", f"g{i}", 100, 100) for i in range(1, 6)], "image_id bigint, stem string, group_id string, width int, height int")
    p = detections(spark, [(1, 24, 0.9, (30, 30, 40, 40)), (1, 24, 0.8, UNIT)])
    got = curation.expert_crops(p, t, images, 20, 0.1, 5, 2.0).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"positive": 2, "negative": 1, "fill": 3}


def test_numbering_and_components(spark):
    names = spark.range(50).select(F.format_string("n%03d", "id").alias("stem"))
    assert [r["id"] for r in curation.ids_by_name(names, "stem").orderBy("stem").collect()] == list(range(1, 51))
    chain = spark.range(30).select(F.format_string("n%03d", "id").alias("left"), F.format_string("n%03d", F.col("id") + 1).alias("right"))
    found = curation.duplicate_components(chain, names)
    assert found.where("canonical = 'n000'").count() == 31 and found.count() == 50


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(S.source_group(F.lit("a_CROP12"))) == "a" and one(S.source_group(F.lit("_crop1"))) == "_crop1"
    assert one(S.threshold_grid(F.lit("0.5, 0.1,0.5"))) == [0.1, 0.5]
    with pytest.raises(Exception, match="threshold grid"):
        one(S.threshold_grid(F.lit("0.5,2")))
    flat = one(S.dct_low(F.array_repeat(F.lit(1.0), 1024)))
    assert flat[0] == pytest.approx(32.0) and max(map(abs, flat[1:])) < 1e-9
