"""Documents of any size from distributed rows: manifests, source-group maps and reports as ordered text parts.

A document's rows are ranged by their place, so part files in the order of their names are the document; no row and no task holds a whole one.
Where the file system can join files by itself, the parts become one file.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.sources.scratch import cut


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The part files of a folder that hold something, in order."""
    fs, path = _path(spark, folder)
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if str(s.getPath().getName()).startswith("part-") and s.getLen() > 0)


def write_ordered(rows: DataFrame, order: list[str], folder: str, line: str = "value") -> list[str]:
    """The column `line` of rows in order as text parts; the folder is put in place at once. A line per row."""
    spark = rows.sparkSession
    staged = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.part"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(line).alias("value")).write.text(staged)
    fs, target = _path(spark, folder)
    fs.delete(target, True)
    if not fs.rename(_path(spark, staged)[1], target):
        raise OSError(f"could not put {folder} in place")
    return parts(spark, folder)


def joined(spark: SparkSession, folder: str, target: str) -> bool:
    """The parts as one file, if the file system joins files without reading them; otherwise nothing is changed, and the folder stays the document."""
    names = parts(spark, folder)
    if not names:
        return False
    fs, first = _path(spark, names[0])
    rest = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(names) - 1)
    for i, n in enumerate(names[1:]):
        rest[i] = _path(spark, n)[1]
    try:
        if len(rest):
            fs.concat(first, rest)
    except Py4JJavaError as e:
        if "UnsupportedOperationException" in e.java_exception.getClass().getName():
            return False
        raise
    return bool(fs.rename(first, _path(spark, target)[1]))


def write_manifests(assigned: DataFrame, root: str) -> dict[str, list[str]]:
    """<root>/<split>.txt of each split (a handful): its stems in order, a line each. assigned: (stem, split)."""
    once = cut(assigned.select("stem", "split").distinct())
    splits = sorted(r[0] for r in once.select("split").distinct().collect())
    return {s: write_ordered(once.where(F.col("split") == s), ["stem"], f"{root.rstrip('/')}/{s}.txt", "stem") for s in splits}


def write_object(entries: DataFrame, folder: str, key: str = "key", body: str = "body") -> list[str]:
    """One JSON object as parts: entries (key, body: JSON text) in order of the key, between braces. A key given twice raises."""
    twice = entries.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key given twice: {twice[0][0]}")
    # the names of fields are quoted as JSON strings; all entries but the first have a comma before them
    name: Column = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    first = entries.agg(F.min(key).alias("m"))
    told = entries.join(F.broadcast(first)).select(F.lit(1).alias("at"), F.col(key).alias("k"), F.concat(F.when(F.col(key) == F.col("m"), "").otherwise(","), name, F.lit(":"), F.col(body)).alias("value"))
    spark = entries.sparkSession
    ends = spark.createDataFrame([(0, "", "{"), (2, "", "}")], "at int, k string, value string")
    return write_ordered(told.unionByName(ends), ["at", "k"], folder)


def write_array(rows: DataFrame, order: list[str], folder: str, body: str = "body") -> list[str]:
    """One JSON array as parts: the column `body` of rows (JSON text) in order, between brackets. `order` must be unique."""
    spark = rows.sparkSession
    place = F.struct(*order)
    first = rows.agg(F.min(place).alias("_first"))
    told = rows.join(F.broadcast(first)).select(F.lit(1).alias("at"), place.alias("k"), F.concat(F.when(place == F.col("_first"), "").otherwise(","), F.col(body)).alias("value"))
    ends = spark.createDataFrame([(0, "["), (2, "]")], "at int, value string").select("at", F.lit(None).cast(told.schema["k"].dataType).alias("k"), "value")
    return write_ordered(told.unionByName(ends), ["at", "k"], folder)


def write_coco(rows: DataFrame, folder: str) -> list[str]:
    """Detections in COCO form (image_id, category_id, bbox, score, and ord, their place in the image) as one JSON array."""
    record = F.to_json(F.struct("image_id", "category_id", "bbox", "score"))
    return write_array(rows.select("image_id", "ord", record.alias("body")), ["image_id", "ord"], folder)


def write_source_groups(assigned: DataFrame, folder: str) -> list[str]:
    """{"<stem>": {"group": .., "split": ..}, ..} over all stems; assigned: (stem, group_id, split)."""
    body = F.to_json(F.struct(F.col("group_id").alias("group"), "split"))
    return write_object(assigned.select(F.col("stem").alias("key"), body.alias("body")), folder)


def write_report(report: DataFrame, folder: str) -> list[str]:
    """A long report (scope, key, tp, fp, fn, recall, fdr) as the document of the report reader: one object of the overall counts and, by coarse class,
    fine class and image, objects of counts, keys in order."""
    counts = F.to_json(F.struct("tp", "fp", "fn", "recall", "fdr"))
    scopes = {"coarse": "by_coarse_class", "fine": "by_fine_class", "image": "by_image", "overall": "overall_class_agnostic"}
    named = F.element_at(F.create_map(*[F.lit(x) for p in scopes.items() for x in p]), F.col("scope"))
    rows = cut(report.select(named.alias("s"), F.col("key").cast("string").alias("k"), counts.alias("b")))
    spark = report.sparkSession
    first = rows.groupBy("s").agg(F.min("k").alias("m"))  # a row a scope
    name = F.regexp_extract(F.to_json(F.struct(F.col("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    inner = rows.where("s <> 'overall_class_agnostic'").join(F.broadcast(first), "s").select("s", F.lit(1).alias("at"), "k", F.concat(F.when(F.col("k") == F.col("m"), "").otherwise(","), name, F.lit(":"), F.col("b")).alias("value"))
    whole = rows.where("s = 'overall_class_agnostic'").select("s", F.lit(1).alias("at"), "k", F.concat(F.lit('"overall_class_agnostic":'), F.col("b")).alias("value"))
    marks = [("", 0, "", "{"), ("~", 0, "", "}")]
    for s in sorted(scopes.values())[:-1]:
        marks += [(s, 0, "", f'"{s}":{{'), (s, 2, "", "},")]
    frame = spark.createDataFrame(marks, "s string, at int, k string, value string")
    return write_ordered(frame.unionByName(inner).unionByName(whole), ["s", "at", "k"], folder)
