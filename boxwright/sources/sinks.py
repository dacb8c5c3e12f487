"""Writers. What is distributed stays a DataFrame of lines or documents; small artifacts are published from the driver."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.sources.readers import demand


def coco_rows(detections: DataFrame, ids: DataFrame, stem: str = "image_id") -> DataFrame:
    """(ord, image_id, category_id, bbox, score): stems become ids (an unknown one raises), corners become x, y, width, height."""
    joined = detections.withColumnRenamed(stem, "stem").join(ids, "stem", "left")
    joined = joined.where(demand(F.col("id").isNotNull(), F.concat(F.lit("no id for "), F.col("stem").cast("string"))))
    return joined.select("ord", F.col("id").alias("image_id"), F.col("class_id").alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), "score")


def check_coco(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The faults of rows: unknown image, box or score out of range, and boxes given twice for one image and class, whatever
    their scores. Empty if the rows may be published."""
    w = Window.partitionBy("image_id", "category_id", "bbox")
    known = ids.select(F.col("id").alias("image_id"), F.lit(True).alias("_known")).distinct()
    j = rows.withColumn("_n", F.count("*").over(w)).join(known, "image_id", "left")
    fault = (
        F.when(F.col("_known").isNull(), "unknown image")
        .when((F.size("bbox") != 4) | (F.get("bbox", 2) <= 0) | (F.get("bbox", 3) <= 0) | F.exists("bbox", lambda v: F.isnan(v)), "bad box")
        .when(~F.col("score").between(0, 1) | F.isnan("score"), "bad score")
        .when(F.col("_n") > 1, "duplicate box")
    )
    return j.select("image_id", "category_id", "ord", fault.alias("fault")).where("fault is not null")


def coco_lines(rows: DataFrame) -> DataFrame:
    """(image_id, value): each image's records as JSON objects in order, comma-joined; concatenating images gives the array's body."""
    record = F.to_json(F.struct("image_id", "category_id", "bbox", "score"))
    items = F.sort_array(F.collect_list(F.struct("ord", record.alias("v"))))
    return rows.groupBy("image_id").agg(F.array_join(F.transform(items, lambda e: e["v"]), ",").alias("value"))


def export_coco(rows: DataFrame, path: str) -> None:
    """One JSON array, streamed to a temporary file and put in place at once."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".part")
    with os.fdopen(handle, "w") as f:
        f.write("[")
        for i, r in enumerate(coco_lines(rows).orderBy("image_id").toLocalIterator()):
            f.write(("," if i else "") + r["value"])
        f.write("]")
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)


def report_document(report: DataFrame) -> DataFrame:
    """(value): the long report as one JSON object with sorted keys."""
    m = F.struct("tp", "fp", "fn", "recall", "fdr")
    by = lambda s: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("scope") == s, F.struct("key", m.alias("m"))))))
    fields = [F.first(F.when(F.col("scope") == "overall", m), ignorenulls=True).alias("overall_class_agnostic")]
    fields += [by(s).alias(n) for s, n in (("coarse", "by_coarse_class"), ("fine", "by_fine_class"), ("image", "by_image"))]
    return report.agg(*fields).select(F.to_json(F.struct("*")).alias("value"))


def coco_ground_truth(annotations: DataFrame) -> DataFrame:
    """annotations (stem, ord, class_id, box, width, height) -> image and annotation ids from 1 by sorted stem, then by place;
    boxes are held inside the image."""
    from boxwright.operators.curation import ids_by_name

    images = ids_by_name(annotations.select("stem").distinct(), "stem", "image_id")
    named = annotations.withColumn("_name", F.concat(F.col("stem"), F.lit("\u0001"), F.lpad(F.col("ord").cast("string"), 12, "0")))
    numbered = ids_by_name(named, "_name", "id").join(images, "stem")
    hold = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(top).cast("double"))
    x1, y1, x2, y2 = hold("x1", "width"), hold("y1", "height"), hold("x2", "width"), hold("y2", "height")
    return numbered.select("id", "image_id", F.col("class_id").alias("category_id"), F.array(x1, y1, x2 - x1, y2 - y1).alias("bbox"), ((x2 - x1) * (y2 - y1)).alias("area"))


def yolo_line(class_id: Column, values: list[Column]) -> Column:
    """A label line with eight decimals."""
    return F.format_string("%d " + " ".join(["%.8f"] * len(values)), class_id, *values)


def yolo_files(labels: DataFrame) -> DataFrame:
    """(stem, value): one label file per stem; labels have class_id, cx, cy, w, h and ord."""
    line = yolo_line(F.col("class_id"), [F.col(c) for c in ("cx", "cy", "w", "h")])
    return labels.groupBy("stem").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("v")))), lambda e: e["v"]), "\n").alias("value"))


def split_manifest(assigned: DataFrame) -> DataFrame:
    """(split, value): sorted stems of each split, a line each, a source-groups map beside it."""
    names = F.array_join(F.sort_array(F.collect_set("stem")), "\n")
    return assigned.groupBy("split").agg(names.alias("value"), F.countDistinct("group_id").alias("groups"))


def validate_dataset(images: DataFrame, labels: DataFrame, manifest: DataFrame, groups: DataFrame) -> DataFrame:
    """(fault, stem): stems that the four listings do not all agree on, and groups in two splits."""
    from boxwright.operators.matching import paired

    out = None
    for name, other in (("label", labels), ("manifest", manifest), ("group", groups)):
        part = paired(images, other, "stem").where("state <> 'paired'").select(F.concat(F.lit(f"{name}: "), F.col("state")).alias("fault"), "stem")
        out = part if out is None else out.unionByName(part)
    j = manifest.join(groups, "stem")
    twice = j.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("group in two splits").alias("fault"), F.col("group_id").alias("stem"))
    return out.unionByName(twice)


def misses(tiles: DataFrame, cached: DataFrame) -> DataFrame:
    """Tiles that a cache, keyed by configuration digest, image fingerprint and tile, does not hold."""
    return tiles.join(cached.select("config", "fingerprint", "tile_id").distinct(), ["config", "fingerprint", "tile_id"], "left_anti")


def write_artifacts(folder: str, documents: dict[str, object], passed: bool = True, only_if_passed: tuple[str, ...] = ()) -> list[str]:
    """JSON, YAML or text documents by file name; those in only_if_passed are left out (and removed) unless passed."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    written = []
    for name, body in documents.items():
        path = root / name
        if name in only_if_passed and not passed:
            path.unlink(missing_ok=True)
            continue
        if name.endswith((".yaml", ".yml")):
            import yaml

            text = yaml.safe_dump(body, sort_keys=True)
        else:
            text = body if isinstance(body, str) else json.dumps(body, indent=2, sort_keys=True)
        temporary = path.with_name(path.name + ".part")
        temporary.write_text(text)
        os.replace(temporary, path)
        written.append(name)
    return written


def markdown_table(rows: list[dict]) -> str:
    """Rows as a Markdown table."""
    if not rows:
        return ""
    names = list(rows[0])
    return "\n".join("| " + " | ".join(str(x) for x in line) + " |" for line in (names, ["---"] * len(names), *([r[n] for n in names] for r in rows))) + "\n"


MARKER = ".boxwright"


def publish(stage: str, target: str, validate) -> None:
    """Put a staged folder in place: the old one (which must bear our marker) is kept aside until the new one validates, and
    comes back if it does not."""
    stage_p, target_p = Path(stage), Path(target)
    (stage_p / MARKER).touch()
    if target_p.exists() and not (target_p / MARKER).exists():
        raise FileExistsError(f"{target} was not published by this library")
    aside = target_p.with_name(target_p.name + ".old")
    if aside.exists():
        shutil.rmtree(aside)
    if target_p.exists():
        os.rename(target_p, aside)
    try:
        os.rename(stage_p, target_p)
        validate(target_p)
    except BaseException:
        if target_p.exists():
            shutil.rmtree(target_p)
        if aside.exists():
            os.rename(aside, target_p)
        raise
    if aside.exists():
        shutil.rmtree(aside)
