"""From images and labels to a published dataset: overlay, audit, union of duplicates, split, staging, validation, commit.

Tables and ordered documents are written beside the target. The staged folder is checked as it will be read, takes the target's place by renames, and
is checked again there; if that fails, or anything before, the old dataset is back as it was. Rows stay distributed; the driver sees one vector of counts per
source group, and the report.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import scalar as S
from boxwright.operators import curation, matching, metrics, splitting
from boxwright.sources import documents, readers, sinks
from boxwright.sources.scratch import cut
from boxwright.taxonomy import coarse_of, dimension

MARKER = "_BOXWRIGHT"
TABLES = ("images", "labels")
LABEL = ("class_id", "ord", "x1", "y1", "x2", "y2", "difficult")


@dataclass(frozen=True)
class Prepared:
    """`images`: (stem, .., group_id, split), `labels`: (stem, ..), both read from the published folder; `report`: the analysis."""

    images: DataFrame
    labels: DataFrame
    report: dict


def overlay(images: DataFrame, labels: DataFrame, reviewed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Labels with those of reviewed stems taken from the review instead, and the reviewed stems. A review row of null class_id says that its
    stem has been looked at and shows nothing; stems without an image raise."""
    if reviewed is None:
        return labels, images.select("stem").where("false")
    stems = cut(reviewed.select("stem").distinct())
    known = stems.join(images.select("stem", F.lit(True).alias("_there")).distinct(), "stem", "left")
    stems = cut(known.where(readers.demand(F.coalesce("_there", F.lit(False)), F.concat(F.lit("a reviewed label without image: "), F.coalesce("stem", F.lit("null"))))).select("stem"))
    rest = labels.join(stems, "stem", "left_anti")
    return rest.unionByName(reviewed.where("class_id is not null").select(*labels.columns)), stems


def grouped(images: DataFrame, duplicates: DataFrame | None) -> DataFrame:
    """images with source_group, from the stem, and group_id: the smallest source group that accepted duplicates (left, right: stems) tie it to."""
    named = images.withColumn("source_group", S.source_group(F.col("stem")))
    if duplicates is None:
        return named.withColumn("group_id", F.col("source_group"))
    pairs = readers.duplicate_pairs(duplicates, images)
    group = named.select("stem", "source_group")
    tied = pairs.join(group.toDF("left", "a"), "left").join(group.toDF("right", "b"), "right").where("a <> b").select(F.col("a").alias("left"), F.col("b").alias("right"))
    roots = curation.duplicate_components(tied, named.select(F.col("source_group").alias("stem")).distinct())
    return named.join(roots.select(F.col("stem").alias("source_group"), F.col("canonical").alias("group_id")), "source_group")


def assigned(images: DataFrame, labels: DataFrame, ratio: float, seed: int, reviewed: DataFrame, taxonomy: str) -> DataFrame:
    """images with their split; the groups of reviewed stems are for validation."""
    spark = images.sparkSession
    vectors = splitting.group_vectors(images.withColumn("image_id", F.col("stem")), labels.withColumn("image_id", F.col("stem")), coarse_of(F.col("class_id"), taxonomy))
    frozen = {r[0] for r in images.join(reviewed, "stem").select("group_id").distinct().collect()}  # source groups
    chosen = splitting.select_validation(vectors, ratio, seed, frozen)
    # a row a source group, as the vectors are
    splits = spark.createDataFrame([(g, "val" if g in chosen else "train") for g in sorted(vectors)], "group_id string, split string")
    return images.join(splits, "group_id")


def faults(spark: SparkSession, folder: str, n_images: int, n_labels: int, least_validation: int, classes: list[int]) -> list[str]:
    """What is wrong with a dataset as it lies in a folder."""
    images, labels = (spark.read.parquet(f"{folder}/{t}") for t in TABLES)
    listed = None
    for split in ("train", "val"):
        lines = spark.read.text(f"{folder}/manifests/{split}.txt").select(F.regexp_extract("value", rf"^images/{split}/(.*)\.jpg$", 1).alias("stem"), F.lit(split).alias("split"))
        listed = lines if listed is None else listed.unionByName(lines)
    told = sinks.validate_dataset(images, images.select("stem"), listed, images.select("stem", "group_id"))
    found = [f"{r['fault']} {r['stem']}" for r in told.orderBy("fault", "stem").limit(10).collect()]
    wrong = listed.join(images.select("stem", F.col("split").alias("_s")), "stem").where("split <> _s").count()
    shown = labels.join(images.select("stem", "split"), "stem").groupBy("split").agg(F.collect_set("class_id").alias("c")).collect()
    counts = {"images": (images.count(), n_images), "labels": (labels.count(), n_labels), "labels without image": (labels.join(images, "stem", "left_anti").count(), 0), "images in another manifest": (wrong, 0)}
    found += [f"{name}: {got} instead of {want}" for name, (got, want) in counts.items() if got != want]
    held = images.where("split = 'val'").count()
    found += [f"validation images: {held}, fewer than {least_validation}"] if held < least_validation else []
    seen = {r["split"]: set(r["c"]) for r in shown}
    return found + [f"class {c} missing from {s}" for s in ("train", "val") for c in classes if c not in seen.get(s, set())]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def replace_folder(spark: SparkSession, staged: str, target: str, check: Callable[[str], None]) -> None:
    """Put a staged folder in the target's place. The old one, which must bear our marker, is kept aside until the new one passes `check` there; if it
    does not, the new one goes and the old one comes back."""
    fs, new = _path(spark, staged)
    _, place = _path(spark, target)
    _, aside = _path(spark, f"{target.rstrip('/')}.backup-{uuid.uuid4().hex}")
    fs.create(_path(spark, f"{staged}/{MARKER}")[1], True).close()
    there = fs.exists(place)
    if there and not fs.exists(_path(spark, f"{target}/{MARKER}")[1]):
        raise FileExistsError(f"{target} was not published by this library")
    if there and not fs.rename(place, aside):
        raise OSError(f"could not set {target} aside")
    try:
        if not fs.rename(new, place):
            raise OSError(f"could not put {staged} in place")
        check(target)
    except BaseException:
        fs.delete(place, True)
        if there:
            fs.rename(aside, place)
        raise
    if there:
        fs.delete(aside, True)


def prepare(
    images: DataFrame, labels: DataFrame, target: str, ratio: float = 0.15, seed: int = 42, reviewed: DataFrame | None = None, duplicates: DataFrame | None = None, taxonomy: str = "scenes25",
    check: Callable[[str], None] | None = None,
) -> Prepared:
    """images (stem, width, height, mode, and phash if near duplicates are to be reported), labels (stem, class_id, ord, box, difficult).
    `check` is called on the folder in place, after the library's own checks."""
    if not 0 < ratio < 0.5:
        raise ValueError("ratio must lie between 0 and 0.5")
    spark = images.sparkSession
    merged, core = overlay(images, labels.select("stem", *LABEL), reviewed)
    merged = cut(merged)
    state = matching.paired(images, merged, "stem").where("state = 'right only'").limit(3).collect()
    if state:
        raise ValueError(f"labels without image: {[r['stem'] for r in state]}")
    if images.count() != images.select("stem").distinct().count():
        raise ValueError("a stem is given twice")
    made = cut(assigned(cut(grouped(images, duplicates)), merged, ratio, seed, core, taxonomy))

    staged = f"{target.rstrip('/')}.stage-{uuid.uuid4().hex}"
    try:
        made.write.parquet(f"{staged}/images")
        merged.write.parquet(f"{staged}/labels")
        entry = F.concat(F.lit("images/"), F.col("split"), F.lit("/"), F.col("stem"), F.lit(".jpg"))
        for split in ("train", "val"):
            documents.write_ordered(made.where(F.col("split") == split).withColumn("value", entry), ["stem"], f"{staged}/manifests/{split}.txt")
        val = made.where("split = 'val'").withColumn("value", entry)
        documents.write_ordered(val.join(core, "stem", "left_semi"), ["stem"], f"{staged}/manifests/val-reviewed-core.txt")
        documents.write_ordered(val.join(core, "stem", "left_anti"), ["stem"], f"{staged}/manifests/val-added.txt")
        documents.write_source_groups(made, f"{staged}/source-groups.json")
        truth = merged.where(~F.col("difficult")).join(made.where("split = 'val'").select("stem", "width", "height"), "stem")
        sinks.coco_ground_truth(truth).write.parquet(f"{staged}/val-ground-truth")
        report = analysis(made, merged, core, ratio, seed, duplicates, taxonomy)
        spark.createDataFrame([(json.dumps(report, sort_keys=True, indent=2),)], "value string").coalesce(1).write.text(f"{staged}/analysis.json")
        wanted = {"n_images": report["source"]["images"], "n_labels": merged.count(), "least_validation": report["minimum_val_images"], "classes": both_sides(made, merged)}

        def sound(folder: str) -> None:
            wrong = faults(spark, folder, **wanted)
            if wrong:
                raise ValueError(f"the dataset is not sound: {wrong}")

        def last(folder: str) -> None:
            sound(folder)
            if check:
                check(folder)

        sound(staged)
        replace_folder(spark, staged, target, last)
    finally:
        fs, path = _path(spark, staged)
        fs.delete(path, True)
    read = [spark.read.parquet(f"{target}/{t}") for t in TABLES]
    return Prepared(*read, report)


def both_sides(images: DataFrame, labels: DataFrame) -> list[int]:
    """Classes that two groups or more show, so that both splits must."""
    n = labels.join(images.select("stem", "group_id"), "stem").where(~F.col("difficult")).groupBy("class_id").agg(F.countDistinct("group_id").alias("n"))
    return sorted(r[0] for r in n.where("n > 1").collect())


def analysis(images: DataFrame, labels: DataFrame, core: DataFrame, ratio: float, seed: int, duplicates: DataFrame | None, taxonomy: str) -> dict:
    """Statistics of the source, of each split, of the review and of the accepted duplicates: a row a class, size, mode or split."""
    spark, named = images.sparkSession, labels.withColumn("image_id", F.col("stem"))
    source: dict = {"images": images.count(), "labels": labels.select("stem").distinct().count(), "raw_source_groups": images.select("source_group").distinct().count()}
    for r in metrics.audit_statistics(images, named).collect():
        source.setdefault({"size": "dimensions", "mode": "modes", "groups": "source_groups", "images": "images_per_class"}.get(r["statistic"], r["statistic"]), {})[r["key"]] = r["n"]
    source["source_groups"] = source["source_groups"]["all"]
    if "phash" in images.columns:
        near = matching.hamming_pairs(images)
        source["near_duplicate_candidates"] = near.count()
    split: dict = {}
    zero = {str(r[0]): 0 for r in dimension(spark, taxonomy).select("class_id").collect()}
    for r in images.groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("group_id").alias("source_groups")).collect():
        split[r["split"]] = {"images": r["images"], "source_groups": r["source_groups"], "targets": dict(zero), "coarse_counts": {}}
    for r in metrics.split_counts(named.join(images.select("stem", "split"), "stem"), taxonomy).collect():
        split[r["split"]]["targets"][str(r["class_id"])] = r["n"]
        coarse = split[r["split"]]["coarse_counts"]
        coarse[r["coarse"]] = coarse.get(r["coarse"], 0) + r["n"]
    overlap = images.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    held, n_core = split.get("val", {}).get("images", 0), core.count()
    return {
        "source": source, "split": split | {"group_overlap": overlap}, "val_ratio": ratio, "minimum_val_images": math.ceil(source["images"] * ratio), "actual_val_ratio": held / max(1, source["images"]), "seed": seed,
        "reviewed": {"core_images": n_core, "added_val_images": held - n_core, "targets": labels.join(core, "stem", "left_semi").count()}, "accepted_duplicate_pairs": 0 if duplicates is None else duplicates.count(),
    }

