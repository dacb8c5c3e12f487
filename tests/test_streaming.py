import json

from boxwright.sources.readers import coco_predictions
from boxwright.streaming import arrivals


def test_files_are_read_once(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    one = {"image_id": "a", "category_id": 1, "bbox": [0.0, 0.0, 2.0, 3.0], "score": 0.5}
    (folder / "1.json").write_text(json.dumps([one, one | {"score": 0.25}]))
    handle = lambda df, n: coco_predictions(df).write.mode("overwrite").parquet(f"{out}/batch={n}")
    run = lambda: arrivals.for_each_batch(arrivals.prediction_files(spark, f"file://{folder}"), handle, f"file://{tmp_path}/state").awaitTermination(60)
    run()
    assert spark.read.parquet(out).count() == 2
    (folder / "2.json").write_text(json.dumps([one]))
    run()
    assert spark.read.parquet(out).count() == 3
