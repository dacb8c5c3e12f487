"""Readers of detection files. Each works on a DataFrame of file contents (path, value), so any store Spark reads will do;
`whole_files` and `lines` make such DataFrames from paths. Order in a file becomes an explicit `ord`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.taxonomy import TAXONOMIES

PREDICTION = "array<struct<image_id:string,category_id:int,bbox:array<double>,score:double>>"
GROUND_TRUTH = "struct<images:array<struct<id:string,file_name:string,width:int,height:int>>,categories:array<struct<id:int,name:string>>,annotations:array<struct<id:bigint,image_id:string,category_id:int,bbox:array<double>,iscrowd:string>>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): numbered within each file by reading files whole, so numbers do not depend on splits."""
    return split_lines(whole_files(spark, path))


def split_lines(files: DataFrame) -> DataFrame:
    body = F.regexp_replace("value", "\\r?\\n$", "")
    return files.where(F.col("value") != "").select("path", F.posexplode(F.split(body, "\\r?\\n")).alias("line_no", "value"))


def demand(ok: Column, message: Column) -> Column:
    """A condition for where(): true, or an error."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def _known(class_id: Column, taxonomy: str) -> Column:
    return class_id.between(0, max(h for _, _, h in TAXONOMIES[taxonomy]))


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _corners(b: Column) -> list[Column]:
    at = lambda i: F.get(b, i)
    return [at(0).alias("x1"), at(1).alias("y1"), (at(0) + at(2)).alias("x2"), (at(1) + at(3)).alias("y2")]


def _good_box(b: Column) -> Column:
    return (F.size(b) == 4) & F.forall(b, _finite) & (F.get(b, 2) > 0) & (F.get(b, 3) > 0)


def coco_predictions(files: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """A JSON array of objects with exactly image_id, category_id, bbox and score."""
    keys = F.transform(F.from_json("value", "array<string>"), lambda s: F.array_sort(F.json_object_keys(s)))
    exact = F.forall(keys, lambda k: k == F.array(*[F.lit(x) for x in ("bbox", "category_id", "image_id", "score")]))
    rows = files.where(demand(F.coalesce(exact, F.lit(False)), F.lit("predictions must hold exactly bbox, category_id, image_id, score")))
    each = rows.select("path", F.posexplode(F.from_json("value", PREDICTION)).alias("ord", "p"))
    ok = _known(F.col("p.category_id"), taxonomy) & _finite(F.col("p.score")) & F.col("p.score").between(0, 1) & _good_box(F.col("p.bbox"))
    each = each.where(demand(F.coalesce(ok, F.lit(False)), F.concat(F.lit("bad prediction "), F.col("ord").cast("string"))))
    return each.select(F.col("p.image_id").alias("image_id"), F.col("p.category_id").alias("class_id"), F.col("ord").cast("bigint").alias("ord"), F.col("p.score").alias("score"), *_corners(F.col("p.bbox")))


def coco_truth(files: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """The annotations of a COCO object; iscrowd 0, 1 or a boolean becomes difficult; further keys are allowed."""
    each = files.select(F.posexplode(F.from_json("value", GROUND_TRUTH)["annotations"]).alias("ord", "a"))
    crowd = F.coalesce(F.lower("a.iscrowd"), F.lit("0"))
    ok = _known(F.col("a.category_id"), taxonomy) & _good_box(F.col("a.bbox")) & crowd.isin("0", "1", "true", "false")
    each = each.where(demand(F.coalesce(ok, F.lit(False)), F.concat(F.lit("bad annotation "), F.col("ord").cast("string"))))
    return each.select(F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("class_id"), F.col("ord").cast("bigint").alias("ord"), *_corners(F.col("a.bbox")), crowd.isin("1", "true").alias("difficult"))


def image_groups(truth_files: DataFrame, group_files: DataFrame) -> DataFrame:
    """(image_id, group_id) of COCO images through a map stem -> {group, split}; all must be of split val, ids and stems unique."""
    images = truth_files.select(F.explode(F.from_json("value", GROUND_TRUTH)["images"]).alias("i")).select(F.col("i.id").alias("image_id"), F.regexp_replace("i.file_name", "\\.[^.]*$", "").alias("stem"))
    groups = group_files.select(F.explode(F.from_json("value", "map<string,struct<group:string,split:string>>")).alias("stem", "g"))
    counted = images.join(groups, "stem", "left")
    twice = images.groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("m")).where("n > 1").select("stem").withColumn("twice", F.lit(True))
    checked = counted.join(twice, "stem", "left").where(demand(F.coalesce((F.col("g.split") == "val") & F.col("twice").isNull(), F.lit(False)), F.concat(F.lit("image without one validation group: "), F.col("stem"))))
    return checked.select("image_id", F.col("g.group").alias("group_id"))


def yolo_boxes(files: DataFrame, taxonomy: str = "scenes25", slack: float = 1e-6) -> DataFrame:
    """Lines `class cx cy w h`, normalised; sides may pass 0 or 1 by the slack and are clamped. Errors name path and line."""
    f = F.split(F.trim("value"), "\\s+")
    v = [F.get(f, i).try_cast("double") for i in range(1, 5)]
    low = [v[0] - v[2] / 2, v[1] - v[3] / 2]
    high = [v[0] + v[2] / 2, v[1] + v[3] / 2]
    ok = (F.size(f) == 5) & _known(F.get(f, 0).try_cast("int"), taxonomy) & (v[2] > 0) & (v[3] > 0)
    for a, b in zip(low, high, strict=True):
        ok = ok & (a >= -slack) & (b <= 1 + slack)
    hold = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    rows = split_lines(files)
    rows = rows.where(demand(F.coalesce(ok, F.lit(False)), F.concat_ws(":", "path", (F.col("line_no") + 1).cast("string"))))
    return rows.select("path", F.col("line_no").cast("bigint").alias("ord"), F.get(f, 0).cast("int").alias("class_id"), hold(low[0]).alias("x1"), hold(low[1]).alias("y1"), hold(high[0]).alias("x2"), hold(high[1]).alias("y2"))


def dota_boxes(files: DataFrame, names: dict[str, int]) -> DataFrame:
    """Lines of eight coordinates, a class of one or more words, and an optional difficult flag. Headers and lines under nine
    tokens are passed over; of several readings of the class the longest known one counts. Rows: path, ord, class_id (null
    for an invalid line), polygon, difficult."""
    known = F.create_map(*[x for n, i in names.items() for x in (F.lit(n), F.lit(i))])
    f = F.split(F.trim("value"), "\\s+")
    rows = split_lines(files).where(~F.lower("value").rlike("^\\s*(imagesource|gsd)\\s*:") & (F.size(f) >= 9)).withColumn("f", f)
    words = F.slice("f", 9, F.greatest(F.size("f") - 8, F.lit(0)))
    tail = F.try_element_at(words, F.lit(-1)).isin("0", "1") & (F.size(words) > 1)
    whole, short = F.array_join(words, " "), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    hit = F.coalesce(known[whole], F.when(tail, known[short]))
    point = lambda i: F.struct(F.get("f", i).try_cast("double").alias("x"), F.get("f", i + 1).try_cast("double").alias("y"))
    p = F.array(*[point(i) for i in (0, 2, 4, 6)])
    good = F.forall(p, lambda q: _finite(q["x"]) & _finite(q["y"]))
    return rows.select("path", F.col("line_no").cast("bigint").alias("ord"), F.when(good, hit).alias("class_id"), p.alias("polygon"), (F.when(tail, F.try_element_at(words, F.lit(-1))) == "1").alias("difficult")).na.fill(False, ["difficult"])


def image_probe(files: DataFrame) -> DataFrame:
    """(path, format, width, height, damaged) of binaryFile rows, from the headers of PNG and of baseline or progressive JPEG.
    Pixels are a decoder's business; sizes need none."""
    @F.pandas_udf("struct<format:string,width:int,height:int,damaged:boolean>")
    def probe(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_size_of(bytes(c)) for c in content], columns=["format", "width", "height", "damaged"])

    return files.select("path", probe("content").alias("p")).select("path", "p.*")


def _size_of(data: bytes) -> tuple:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), b"IEND" not in data[-12:]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big"), data[-2:] != b"\xff\xd9"
            at += 2 + size
    return None, None, None, True


def image_ids(files: DataFrame) -> DataFrame:
    """(stem, id) of a JSON map; ids must be unique and not negative."""
    rows = files.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("stem", "id"))
    shared = rows.groupBy("id").agg(F.count("*").alias("n"))
    return rows.join(shared, "id").where(demand(F.coalesce((F.col("n") == 1) & (F.col("id") >= 0), F.lit(False)), F.concat(F.lit("bad id of "), F.col("stem")))).select("stem", "id")


def named_predictions(models: dict[str, DataFrame]) -> DataFrame:
    """One table of several models' detections, with a model column."""
    out = None
    for name, df in models.items():
        part = df.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def parse_named(specs: list[str]) -> dict[str, str]:
    """NAME=PATH arguments; a repeated name is an error."""
    out: dict[str, str] = {}
    for spec in specs:
        name, equals, path = spec.partition("=")
        if not (name and equals and path) or name in out:
            raise ValueError(f"expected distinct NAME=PATH, got {spec!r}")
        out[name] = path
    return out


COUNTS = "struct<tp:bigint,fp:bigint,fn:bigint,recall:double,fdr:double>"
REPORT = f"struct<overall_class_agnostic:{COUNTS},by_coarse_class:map<string,{COUNTS}>,by_fine_class:map<string,{COUNTS}>,by_image:map<string,{COUNTS}>>"


def report_json(files: DataFrame, slack: float | None = None) -> DataFrame:
    """A report file as the long table, rates recomputed from counts. With a slack, stored rates must agree with them."""
    from boxwright.operators.metrics import rated

    r = files.select(F.from_json("value", REPORT).alias("r"))
    part = lambda scope, field: r.select(F.lit(scope).alias("scope"), F.explode(F.col(f"r.{field}")).alias("key", "m"))
    every = r.select(F.lit("overall").alias("scope"), F.lit("all").alias("key"), F.col("r.overall_class_agnostic").alias("m"))
    for scope, field in (("coarse", "by_coarse_class"), ("fine", "by_fine_class"), ("image", "by_image")):
        every = every.unionByName(part(scope, field))
    stored = every.select("scope", "key", "m.tp", "m.fp", "m.fn", F.col("m.recall").alias("stored_recall"), F.col("m.fdr").alias("stored_fdr"))
    out = rated(stored)
    if slack is not None:
        same = (F.abs(F.col("recall") - F.col("stored_recall")) <= slack) & (F.abs(F.col("fdr") - F.col("stored_fdr")) <= slack)
        out = out.where(demand(F.coalesce(same, F.lit(False)), F.concat(F.lit("rates disagree with counts: "), F.col("scope"), F.lit(" "), F.col("key"))))
    return out.drop("stored_recall", "stored_fdr")


def duplicate_pairs(rows: DataFrame, stems: DataFrame) -> DataFrame:
    """(left, right) of a CSV with such columns: trimmed; self-pairs, repeats (either way round) and unknown stems raise."""
    p = rows.select(F.trim("left").alias("left"), F.trim("right").alias("right"))
    p = p.withColumn("_k", F.concat_ws("\u0001", F.least("left", "right"), F.greatest("left", "right")))
    counted = p.join(p.groupBy("_k").agg(F.count("*").alias("_n")), "_k")
    known = stems.select(F.col("stem")).distinct()
    for side in ("left", "right"):
        counted = counted.join(known.select(F.col("stem").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    ok = (F.col("left") != F.col("right")) & (F.col("_n") == 1) & F.col("_left") & F.col("_right")
    return counted.where(demand(F.coalesce(ok, F.lit(False)), F.concat_ws(" ", F.lit("bad pair"), "left", "right"))).select("left", "right")


def jsonl_manifest(rows: DataFrame) -> DataFrame:
    """Records (crop, label, ...) from JSON lines; labels must be 0 or 1."""
    schema = "crop string, image_id string, proposal_index bigint, label int, reason string, sph_score double, width_norm double, height_norm double, source_group string"
    parsed = rows.select(F.from_json("value", schema).alias("r")).select("r.*")
    return parsed.where(demand(F.coalesce(F.col("label").isin(0, 1), F.lit(False)), F.lit("a label must be 0 or 1")))


def boxes_from_arrays(frames: DataFrame, least: float) -> DataFrame:
    """frames: image_id, boxes array<array<double>> (x1 y1 x2 y2), scores, labels -> rows over the score that enclose area."""
    each = frames.select("image_id", F.posexplode(F.arrays_zip("boxes", "scores", "labels")).alias("ord", "e"))
    b = F.col("e.boxes")
    rows = each.select("image_id", F.col("e.labels").alias("class_id"), F.col("ord").cast("bigint").alias("ord"), F.col("e.scores").alias("score"), *[F.get(b, i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    return rows.where((F.col("score") >= least) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def annotation_metadata(files: DataFrame) -> DataFrame:
    """(category_ids, n_images) of a COCO object."""
    r = F.from_json("value", GROUND_TRUTH)
    return files.select(F.array_sort(F.array_distinct(F.transform(r["categories"], lambda c: c["id"]))).alias("category_ids"), F.size(r["images"]).cast("bigint").alias("n_images"))


def yaml_config(text: str, allowed: set[str]) -> dict:
    """A YAML mapping; unknown keys are an error."""
    import yaml

    out = yaml.safe_load(text)
    if not isinstance(out, dict) or set(out) - allowed:
        raise ValueError(f"unknown keys: {sorted(set(out) - allowed) if isinstance(out, dict) else out!r}")
    return out


def reviewed_archive(path: str, expected: dict[str, str]) -> dict[str, str]:
    """Label texts by stem from a ZIP <root>/images/.. and <root>/labels/.. whose images have the expected SHA-256 digests.
    Entries with absolute or upward paths, links and encryption are refused."""
    import hashlib
    import zipfile
    from pathlib import PurePosixPath

    images, labels, roots = {}, {}, set()
    with zipfile.ZipFile(path) as z:
        for e in z.infolist():
            p = PurePosixPath(e.filename)
            if p.is_absolute() or ".." in p.parts or e.flag_bits & 1 or (e.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"refused entry {e.filename!r}")
            if e.is_dir():
                continue
            roots.add(p.parts[0])
            if "images" in p.parts:
                images[p.stem] = hashlib.sha256(z.read(e)).hexdigest()
            elif "labels" in p.parts:
                labels[p.stem] = z.read(e).decode()
    if len(roots) != 1 or set(images) != set(labels):
        raise ValueError("the archive needs one root, and a label for each image")
    wrong = [s for s, h in images.items() if expected.get(s) != h]
    if wrong:
        raise ValueError(f"images differ from their sources: {sorted(wrong)[:5]}")
    return labels
