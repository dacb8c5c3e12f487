"""Examples for a second opinion on vehicles: labelled proposals as crops of pixels, split by source group, numbered and listed.

Proposals that repeat a detection of the main model are left out. Groups are split so that both sides hold positives and negatives; an example's number is
its place by group, image and proposal within its side, counted over ranges. An image's raster meets its proposals once, as one row.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators import metrics, rasters, splitting
from boxwright.sources import documents
from boxwright.sources.scratch import cut
from boxwright.sources.sinks import write_artifacts


@dataclass(frozen=True)
class CropPolicy:
    """Crops are squares of context_scale times the longer side, held between min_side and max_side, brought to output_size."""

    context_scale: float = 2.0
    min_side: int = 64
    max_side: int = 256
    output_size: int = 160
    holdout_ratio: float = 0.20
    seed: int = 42

    def __post_init__(self) -> None:
        if not (math.isfinite(self.context_scale) and self.context_scale > 0):
            raise ValueError("context_scale must be finite and positive")
        if not 0 < self.min_side <= self.max_side or self.output_size <= 0:
            raise ValueError("sides must be positive, min_side at most max_side")
        if not 0 < self.holdout_ratio < 1 or self.seed < 0:
            raise ValueError("holdout_ratio must lie between 0 and 1, and the seed be no less than 0")

    def side(self, width: float, height: float) -> int:
        return max(self.min_side, min(self.max_side, round(self.context_scale * max(width, height))))


def _weights(size: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each output place, the source place before it and the two weights in 1/2048."""
    at = (np.arange(out) + 0.5) * (size / out) - 0.5
    first = np.floor(at).astype(int)
    part = np.where((first < 0) | (first >= size - 1), 0.0, at - first)
    return np.clip(first, 0, size - 1), np.rint((1 - part) * 2048).astype(np.int64), np.rint(part * 2048).astype(np.int64)


def bilinear(pixels: np.ndarray, size: int) -> np.ndarray:
    """size x size between the nearest four pixels, in whole numbers."""
    height, width = pixels.shape[:2]
    x, a, b = _weights(width, size)
    across = pixels[:, x].astype(np.int64) * a[None, :, None] + pixels[:, np.minimum(x + 1, width - 1)].astype(np.int64) * b[None, :, None]
    y, c, d = _weights(height, size)
    up, down = across[y] >> 4, across[np.minimum(y + 1, height - 1)] >> 4
    value = ((c[:, None, None] * up) >> 16) + ((d[:, None, None] * down) >> 16)
    return np.clip((value + 2) >> 2, 0, 255).astype(np.uint8)


def crop(pixels: np.ndarray, box: tuple[float, float, float, float], policy: CropPolicy) -> np.ndarray:
    """The square around a box, black where the image ends, at the output size."""
    x1, y1, x2, y2 = box
    side = policy.side(x2 - x1, y2 - y1)
    left, top = math.floor((x1 + x2) / 2 - side / 2), math.floor((y1 + y2) / 2 - side / 2)
    height, width, channels = pixels.shape
    canvas = np.zeros((side, side, channels), np.uint8)
    a, b, c, d = max(0, left), max(0, top), min(width, left + side), min(height, top + side)
    if c > a and d > b:
        canvas[b - top : d - top, a - left : c - left] = pixels[b:d, a:c]
    return bilinear(canvas, policy.output_size)


def examples(labelled: DataFrame, images: DataFrame, policy: CropPolicy) -> DataFrame:
    """(split, number, crop, image_id, ord, label, reason, score, width_norm, height_norm, group_id, box) of labelled proposals (with reason); images:
    image_id, group_id, width, height."""
    kept = cut(labelled.where("reason <> 'duplicate_main'").join(images.select("image_id", "group_id", "width", "height"), "image_id"))
    counts = kept.groupBy("group_id").agg(F.sum("label").cast("int").alias("p"), F.count("*").cast("int").alias("n")).collect()  # a row a source group
    if not counts:
        raise ValueError("no proposals but duplicates")
    held = splitting.combination_of_counts({r["group_id"]: (r["p"], r["n"] - r["p"]) for r in counts}, policy.holdout_ratio, policy.seed)
    splits = kept.sparkSession.createDataFrame([(r["group_id"], "holdout" if r["group_id"] in held else "train") for r in counts], "group_id string, split string")
    numbered = metrics.ranked_in_ranges(kept.join(splits, "group_id"), "split", [F.col("group_id"), F.col("image_id"), F.col("ord")], [], "number")
    name = F.concat(F.lit("crops/"), "split", F.lit("/"), F.lpad(F.col("number").cast("string"), 6, "0"), F.lit(".png"))
    sizes = [((F.col("x2") - F.col("x1")) / F.col("width")).alias("width_norm"), ((F.col("y2") - F.col("y1")) / F.col("height")).alias("height_norm")]
    return numbered.select("split", "number", name.alias("crop"), "image_id", "ord", "label", "reason", "score", *sizes, "group_id", "x1", "y1", "x2", "y2")


def crops(made: DataFrame, pictures: DataFrame, policy: CropPolicy) -> DataFrame:
    """(crop, content): the PNG of each example; pictures: rasters of uint8."""
    # a crop costs far more time than its row's bytes say, so the partitions are not merged by size
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxes = made.repartition(n, "image_id").groupBy("image_id").agg(F.collect_list(F.struct("crop", "x1", "y1", "x2", "y2")).alias("boxes"))  # an image's proposals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                width, height, channels, data, wanted = (batch.column(c)[at].as_py() for c in ("width", "height", "channels", "pixels", "boxes"))
                whole = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                for b in wanted:
                    found = rasters.encode_png(crop(whole, (b["x1"], b["y1"], b["x2"], b["y2"]), policy))
                    yield pa.RecordBatch.from_arrays([pa.array([b["crop"]]), pa.array([found], pa.binary())], names=["crop", "content"])

    return pictures.join(boxes, "image_id").select("width", "height", "channels", "pixels", "boxes").mapInArrow(run, "crop string, content binary")


def write_dataset(labelled: DataFrame, images: DataFrame, pictures: DataFrame, folder: str, policy: CropPolicy | None = None) -> DataFrame:
    """<folder>/manifests/<split>.jsonl as ordered parts, crops (crop, content) as a table, and reports/dataset.json and .md; the examples are returned."""
    policy = policy or CropPolicy()
    made = cut(examples(labelled, images, policy))
    record = F.to_json(F.struct("crop", "image_id", F.col("ord").alias("proposal_index"), "label", "reason", "score", "width_norm", "height_norm", F.col("group_id").alias("source_group")))
    report: dict = {"policy": policy.__dict__}
    for split in ("train", "holdout"):
        mine = made.where(F.col("split") == split)
        documents.write_ordered(mine.withColumn("value", record), ["number"], f"file://{folder}/manifests/{split}.jsonl")
        groups = sorted(r[0] for r in mine.select("group_id").distinct().collect())
        n = mine.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
        report[split] = {"examples": n["n"], "positive": n["p"], "negative": n["n"] - n["p"], "groups": groups, "group_hashes": [hashlib.sha256(g.encode()).hexdigest() for g in groups]}
    crops(made, pictures, policy).write.mode("overwrite").parquet(f"file://{folder}/crops")
    text = "# Confirmer dataset\n\n" + "".join(f"- {s}: {report[s]['examples']} examples, {len(report[s]['groups'])} groups\n" for s in ("train", "holdout"))
    write_artifacts(f"{folder}/reports", {"dataset.json": json.loads(json.dumps(report)), "dataset.md": text})
    return made
