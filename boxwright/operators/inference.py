"""The inference pipeline around a pluggable detector: tiles, a mapInPandas seam, projection, merging."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import axis_positions, tile_stride
from boxwright.operators import filters, suppression
from boxwright.sources.scratch import cut

TILE_BOX = "image_id bigint, tile_id string, tile_x bigint, tile_y bigint, valid_width bigint, valid_height bigint, image_width int, image_height int, class_id int, ord bigint, score double, x1 double, y1 double, x2 double, y2 double"


def tiles(images: DataFrame, size: int, overlap: float) -> DataFrame:
    """images (image_id, width, height) -> tiles from top to bottom and left to right, the last ones flush with the edges."""
    stride = tile_stride(F.lit(size), F.lit(overlap))
    xs, ys = axis_positions(F.col("width"), F.lit(size), stride), axis_positions(F.col("height"), F.lit(size), stride)
    t = images.select("image_id", "width", "height", F.explode(ys).alias("y"), xs.alias("xs")).select("image_id", "width", "height", "y", F.explode("xs").alias("x"))
    name = F.concat(F.col("image_id").cast("string"), F.lit("__x"), F.col("x").cast("string"), F.lit("_y"), F.col("y").cast("string"), F.lit(f"_s{size}"))
    return t.select("image_id", name.alias("tile_id"), "x", "y", F.least(F.lit(size), F.col("width") - F.col("x")).alias("valid_width"), F.least(F.lit(size), F.col("height") - F.col("y")).alias("valid_height"), "width", "height")


def synthetic_rectangles(spark, width: int, height: int, step: int) -> DataFrame:
    """The rectangles of a synthetic test image: a grid, sizes and colours from their places."""
    x = F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(step))).alias("x")
    grid = spark.range(1).select(x).select("x", F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(step))).alias("y"))
    w = lambda top: F.least(F.lit(step // 2) + (F.col("x") + F.col("y")) % (step // 4), F.lit(top))
    return grid.select("x", "y", w(width).alias("w"), w(height).alias("h"), ((F.col("x") * 7 + F.col("y") * 13) % 256).alias("grey"))


def predict_with_backoff(detector: Callable, rows: list, batch: int) -> tuple[list, int]:
    """Predictions of rows in batches; when memory runs out the batch is halved, and stays so. A single row that does not fit raises."""
    out, at = [], 0
    while at < len(rows):
        try:
            out += detector(rows[at : at + batch])
            at += batch
        except MemoryError:
            if batch == 1:
                raise
            batch = max(1, batch // 2)
    return out, batch


def detect(tile_rows: DataFrame, detector: Callable[[list[dict]], list[list[dict]]], batch: int = 16) -> DataFrame:
    """Tiles through the detector: a function of a list of tile records that gives a list of boxes for each."""
    names = [c.split()[0] for c in TILE_BOX.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = batch
        for frame in frames:
            records = frame.to_dict("records")
            found, size = predict_with_backoff(detector, records, size)
            rows = [
                (t["image_id"], t["tile_id"], t["x"], t["y"], t["valid_width"], t["valid_height"], t["width"], t["height"], b["class_id"], i, b["score"], *b["box"])
                for t, boxes in zip(records, found, strict=True)
                for i, b in enumerate(boxes)
            ]
            yield pd.DataFrame(rows, columns=names)

    return tile_rows.mapInPandas(run, TILE_BOX)


def place(found: DataFrame, thresholds: DataFrame, margin: float, merge_iou: float) -> DataFrame:
    """Boxes of tiles over their class thresholds, without those at inner edges, on the image, merged."""
    placed = filters.to_image(filters.pipeline_filter(found, thresholds).where(filters.inside_tile(margin)))
    # one order over the image: the tile's place, then the place in it
    ranked = placed.withColumn("ord", F.xxhash64("tile_y", "tile_x") * 0 + F.col("tile_y") * 10_000_000_000 + F.col("tile_x") * 10_000 + F.col("ord"))
    return suppression.merge_detections(ranked.select(*suppression.FIELDS), merge_iou)


def run_pipeline(images: DataFrame, detector: Callable, thresholds: DataFrame, size: int, overlap: float, margin: float, merge_iou: float, rules: DataFrame | None = None, area_rules: DataFrame | None = None) -> DataFrame:
    """Tiles -> detector -> class thresholds -> edge filter -> projection -> merging -> class suppression -> area filter."""
    merged = place(detect(tiles(images, size, overlap), detector), thresholds, margin, merge_iou)
    if rules is not None:
        merged = suppression.suppress_classes(merged, rules)
    if area_rules is not None:
        merged = filters.drop_low_and_small(merged, area_rules)
    return merged


STAGES = ("preprocess", "inference", "postprocess")


def benchmark(images: DataFrame, detector: Callable, thresholds: DataFrame, size: int, overlap: float, margin: float, merge_iou: float, repeats: int = 5, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(stage, repeat, seconds) of each stage of the pipeline and of all ('total'), after one run that does not count. A stage ends when its rows are
    written, so that the next one does not do its work again. metrics.durations and latency_gate sum them up."""
    if isinstance(repeats, bool) or not isinstance(repeats, int) or repeats <= 0:
        raise ValueError("repeats must be a positive whole number")

    def once() -> list[float]:
        began = [clock()]
        cutout = cut(tiles(images, size, overlap))
        began.append(clock())
        found = cut(detect(cutout, detector))
        began.append(clock())
        place(found, thresholds, margin, merge_iou).write.format("noop").mode("overwrite").save()
        began.append(clock())
        return [b - a for a, b in zip(began, began[1:])]

    once()
    rows = [(stage, k, s) for k in range(repeats) for took in [once()] for stage, s in (*zip(STAGES, took), ("total", sum(took)))]
    return images.sparkSession.createDataFrame(rows, "stage string, repeat int, seconds double")
