"""Typed configurations."""

import pytest
import yaml

from boxwright import cli
from boxwright.operators import inference, metrics
from boxwright.sources.configs import MultiscalePolicy, PipelineConfig

FULL = {"taxonomy": "legacy3", "tile_size": 64, "overlap": 0.25, "merge_iou": 0.5, "model_path": "m", "class_thresholds": {0: 0.1, 1: 0.2, 2: 0.3}, "class_suppression": {1: {"method": "diou", "threshold": 0.4}}, "class_low_score_area_filters": {2: {"score_ceiling": 0.5, "min_area": 40}}}


def test_a_config_is_read_and_told_again(spark):
    c = PipelineConfig.from_yaml(yaml.safe_dump(FULL))
    assert c.tile_size == 64 and c.image_size == 1024 and c.class_thresholds == {0: 0.1, 1: 0.2, 2: 0.3}
    assert PipelineConfig(**c.to_dict()) == c
    thresholds, rules, areas = c.tables(spark)
    assert thresholds.count() == 3 and tuple(rules.first()) == (1, "diou", 0.4) and tuple(areas.first()) == (2, 0.5, 40.0)


@pytest.mark.parametrize(
    "change",
    [
        {"task": "draw"}, {"taxonomy": "other"}, {"tile_size": 0}, {"batch_size": True}, {"overlap": 1.0}, {"merge_iou": 1.5}, {"edge_margin": -1}, {"unknown": 1}, {"class_thresholds": {0: 0.1}}, {"class_thresholds": [1]},
        {"class_thresholds": {0: 0.1, 1: 0.2, 2: 1.3}}, {"class_suppression": {7: {"method": "iou", "threshold": 0.4}}}, {"class_suppression": {1: {"method": "giou", "threshold": 0.4}}}, {"class_suppression": {1: {"threshold": 0.4}}},
        {"class_low_score_area_filters": {1: {"score_ceiling": 2, "min_area": 1}}}, {"class_low_score_area_filters": {1: {"score_ceiling": 0.5, "min_area": -1}}},
    ],
)
def test_what_is_wrong_is_refused(change):
    with pytest.raises(ValueError):
        PipelineConfig.from_yaml(yaml.safe_dump(FULL | change))


def test_the_policy_of_scales():
    own = {"taxonomy": "legacy3", "class_thresholds": {0: 0.1, 1: 0.2, 2: 0.3}, "aircraft_supplement_threshold": 0.5, "aircraft_duplicate_iou": 0.3, "ship_supplement_threshold": 0.6, "ship_duplicate_iou": 0.4, "vehicle_score_ceiling": 0.4, "vehicle_min_area": 30}
    assert MultiscalePolicy.from_yaml(yaml.safe_dump(own)).pair("ship") == (0.6, 0.4)
    for change in ({"ship_duplicate_iou": 2}, {"vehicle_min_area": -1}, {"other": 1}):
        with pytest.raises(ValueError):
            MultiscalePolicy.from_yaml(yaml.safe_dump(own | change))
    with pytest.raises(ValueError):
        MultiscalePolicy.from_yaml(yaml.safe_dump({k: v for k, v in own.items() if k != "ship_duplicate_iou"}))


def test_a_pipeline_by_its_config(spark):
    c = PipelineConfig.from_yaml(yaml.safe_dump(FULL | {"class_suppression": {}, "class_low_score_area_filters": {}, "edge_margin": 0}))
    images = spark.createDataFrame([(1, 100, 64)], "image_id bigint, width int, height int")
    found = c.run(images, lambda tiles: [[{"class_id": 0, "score": 0.9, "box": (50.0 - t["x"], 20.0, 60.0 - t["x"], 30.0)}] for t in tiles]).collect()
    assert [(r["x1"], r["x2"]) for r in found] == [(50.0, 60.0)]


def test_stages_are_timed_after_a_run_that_does_not_count(spark):
    images = spark.createDataFrame([(1, 100, 64)], "image_id bigint, width int, height int")
    thresholds = spark.createDataFrame([(c, 0.1) for c in range(25)], "class_id int, threshold double")
    ticks = iter(x * x for x in range(100))  # each stage of a run takes two more than the one before
    found = inference.benchmark(images, lambda tiles: [[] for _ in tiles], thresholds, 64, 0.25, 0.0, 0.5, repeats=2, clock=lambda: float(next(ticks)))
    rows = {(r["stage"], r["repeat"]): r["seconds"] for r in found.collect()}
    assert rows == {("preprocess", 0): 9.0, ("inference", 0): 11.0, ("postprocess", 0): 13.0, ("total", 0): 33.0, ("preprocess", 1): 17.0, ("inference", 1): 19.0, ("postprocess", 1): 21.0, ("total", 1): 57.0}
    told = {r["stage"]: (r["median"], r["p95"], r["passed"]) for r in metrics.latency_gate(found, "seconds", 50.0, 1.0, "stage").collect()}
    assert told["total"] == (45.0, pytest.approx(55.8), False) and told["inference"][2]
    for wrong in (0, True, 1.5):
        with pytest.raises(ValueError):
            inference.benchmark(images, lambda tiles: [], thresholds, 64, 0.25, 0.0, 0.5, repeats=wrong)


def test_commands_are_there():
    assert {"prepare-dataset", "hash-images", "suppress-outlines", "check-config", "accept-threshold", "accept-threshold-pair", "evaluate-detection-metrics"} <= set(cli.COMMANDS)
