"""Artifacts of searches and calibrations, as they lie in a folder."""

import glob
import json
import os

import pytest
import yaml

from boxwright.operators import calibration, metrics, search
from boxwright.sources import artifacts
from tests.helpers import detections, truths
from tests.test_splits import at, scene


def load(path):
    if os.path.isdir(path):
        return json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))))
    with open(path) as f:
        return yaml.safe_load(f) if path.endswith(".yaml") else json.load(f) if path.endswith(".json") else f.read()


@pytest.fixture(scope="module")
def reports(spark):
    t = truths(spark, [(1, 0, at(0)), (1, 4, at(20)), (1, 24, at(40)), (2, 0, at(0))])
    rows = [(1, 0, 0.9, at(0)), (1, 4, 0.9, at(20)), (1, 24, 0.9, at(40)), (2, 0, 0.9, at(0)), (2, 0, 0.5, at(90)), (2, 4, 0.5, at(120)), (2, 24, 0.5, at(150))]
    report = lambda keep: metrics.evaluate(detections(spark, [r for i, r in enumerate(rows) if i in keep]), t)
    return report({0, 4, 5, 6}), report({0, 1, 2, 3}), report({0, 1, 2, 3, 4})


def test_thresholds(reports, tmp_path):
    worse, best, _ = reports
    made = artifacts.write_thresholds(f"{tmp_path}", {4: 0.5, 0: 0.25}, search.Objective(4, 0, 0), best, [0.25, 0.5], 0.9, worse)
    assert load(f"{tmp_path}/optimized-thresholds.yaml") == {"class_thresholds": {0: 0.25, 4: 0.5}}
    summary = load(f"{tmp_path}/search-summary.json")
    assert summary["objective"]["f1"] == 1.0 and summary["baseline_objective"]["tp"] == 1 and summary["thresholds"] == {"0": 0.25, "4": 0.5}
    overall = next(r for r in load(f"{tmp_path}/comparison.json")["rows"] if r["scope"] == "overall")
    assert overall["recall_change"] == 0.75 and overall["fdr_change"] == -0.75
    report = load(f"{tmp_path}/report.json")
    assert report["overall_class_agnostic"]["tp"] == 4 and set(report["by_image"]) == {"1", "2"} and len(report["by_fine_class"]) == 25
    assert "| 0 | 0.25 |" in load(f"{tmp_path}/search-summary.md") and set(made) >= {"comparison.md", "report.json"}


def test_ranking_gate(reports, tmp_path):
    worse, best, mixed = reports
    base = {r["key"]: search.Objective(r["tp"], r["fp"], r["fn"]) for r in worse.where("scope = 'coarse'").collect()}
    artifacts.write_ranking(f"{tmp_path}/all", {0: 0.5}, best, base)
    assert load(f"{tmp_path}/all/summary.json")["improved_accuracy_items"] == 6 and load(f"{tmp_path}/all/summary.json")["single_weight_gate_passed"]
    own = {r["key"]: search.Objective(r["tp"], r["fp"], r["fn"]) for r in mixed.where("scope = 'coarse'").collect()}
    artifacts.write_ranking(f"{tmp_path}/none", {0: 0.5}, mixed, own)
    assert load(f"{tmp_path}/none/summary.json")["improved_accuracy_items"] == 0 and not load(f"{tmp_path}/none/summary.json")["single_weight_gate_passed"]


def test_competition_and_seven(reports, tmp_path):
    worse, best, mixed = reports
    artifacts.write_competition(f"{tmp_path}", best, "one")
    assert load(f"{tmp_path}/competition-proxy.json")["verdict"] == "pass_candidate" and load(f"{tmp_path}/competition-proxy.json")["seconds"] is None
    artifacts.write_competition(f"{tmp_path}", best, "one", 21.0)
    assert load(f"{tmp_path}/competition-proxy.json")["verdict"] == "timing_gate_failed"
    artifacts.write_competition(f"{tmp_path}", worse, "one", 21.0)
    assert load(f"{tmp_path}/competition-proxy.json")["verdict"] == "accuracy_gate_failed" and "accuracy_gate_failed" in load(f"{tmp_path}/competition-proxy.md")
    artifacts.write_seven(f"{tmp_path}", worse, best, 3.0, 3.0)
    seven = load(f"{tmp_path}/seven-metric-comparison.json")
    assert seven["improved"] == 6 and seven["regressed"] == 0 and seven["promote"] and seven["metrics"][-1] == {"metric": "seconds", "baseline": 3.0, "experiment": 3.0, "delta": 0.0, "status": "tied"}
    artifacts.write_seven(f"{tmp_path}", best, mixed, 3.0, 4.0)
    assert not load(f"{tmp_path}/seven-metric-comparison.json")["promote"]


def test_calibration(spark, tmp_path):
    base, cand, truth, folds = scene(spark, [(0, 0.9, 0.0), (0, 0.4, 100.0), (4, 0.9, 20.0), (4, 0.3, 140.0)])
    passed = calibration.calibrate_pair(cand, truth, folds, [0.25, 0.35, 0.45], baseline_detections=base)
    folder = f"{tmp_path}/c"
    artifacts.write_calibration(folder, passed, cand, truth, folds, {"tile_size": 640, "class_thresholds": {}})
    thresholds = load(f"{folder}/calibrated-thresholds.yaml")
    assert thresholds["strategy"] == "ship-override" and {thresholds["class_thresholds"][c] for c in range(4)} == {0.45} and {thresholds["class_thresholds"][c] for c in range(4, 25)} == {0.35}
    assert load(f"{folder}/calibrated-config.yaml") == {"tile_size": 640, "class_thresholds": thresholds["class_thresholds"]}
    assert load(f"{folder}/calibration-summary.json")["status"] == "passed" and len(load(f"{folder}/fold-results.json")) == 3
    assert load(f"{folder}/fold-assignments.json") == {str(i): i % 3 for i in range(1, 7)}
    assert load(f"{folder}/oof-report.json")["overall_class_agnostic"] == {"tp": 12, "fp": 0, "fn": 0, "recall": 1.0, "fdr": 0.0}
    lines = load(f"{folder}/oof-predictions.json")
    assert len(lines) == 12 and [x["image_id"] for x in lines] == sorted(x["image_id"] for x in lines)

    failed = calibration.calibrate_pair(cand, truth, folds, [0.25, 0.35, 0.45], baseline_detections=base, limits=calibration.PAIR_LIMITS | {"oof_recall": 1.1})
    artifacts.write_calibration(folder, failed, cand, truth, folds)
    assert load(f"{folder}/calibration-summary.json")["status"] == "failed" and not glob.glob(f"{folder}/calibrated-*")
    with pytest.raises(ValueError, match="failed calibration"):
        artifacts.write_calibration(folder, failed, cand, truth, folds, {"tile_size": 640})
