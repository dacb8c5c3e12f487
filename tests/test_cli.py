import json

from boxwright import cli

ONE = {"image_id": "a", "category_id": 0, "bbox": [0.0, 0.0, 10.0, 10.0], "score": 0.9}
TRUTH = {"images": [{"id": "a", "file_name": "a.jpg"}], "categories": [], "annotations": [{"image_id": "a", "category_id": 0, "bbox": [0.0, 0.0, 10.0, 10.0], "iscrowd": 0}]}


def files(tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([ONE, ONE | {"score": 0.4}]))
    (tmp_path / "t.json").write_text(json.dumps(TRUTH))
    return f"file://{tmp_path}/p.json", f"file://{tmp_path}/t.json"


def run(spark, capsys, *argv):
    assert cli.main(list(argv), spark) == 0
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_evaluate(spark, tmp_path, capsys):
    rows = run(spark, capsys, "evaluate", *files(tmp_path))
    overall = next(r for r in rows if r["scope"] == "overall")
    assert (overall["tp"], overall["fp"], overall["fn"]) == (1, 1, 0)


def test_sweep_and_suppression(spark, tmp_path, capsys):
    p, t = files(tmp_path)
    rows = run(spark, capsys, "sweep-thresholds", p, t, "--thresholds", "0.3,0.5")
    assert sorted((r["threshold"], r["fp"]) for r in rows) == [(0.3, 1), (0.5, 0)]
    assert [r["score"] for r in run(spark, capsys, "apply-suppression", p, "--classes", "0")] == [0.9]


def test_every_command_has_a_parser(spark):
    assert {"evaluate", "calibrate-thresholds", "fuse-same-weight-multiscale", "compare-seven-metrics", "find-duplicates"} <= set(cli.COMMANDS)
