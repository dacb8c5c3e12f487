"""Predictions of tiles, kept by what they were made from.

An entry is a line under the digest of its configuration, image fingerprint and tile: a checksum and the predictions as JSON. Entries lie in
folders by the first two digits of their digest, so that a load reads only the folders that its tiles fall into. A save writes a batch of its own beside the
others and renames it at the end; writers never share a folder, and readers see a batch whole or not at all. Of several entries for a tile the
one of the latest batch counts. A line that is cut off, altered, of another version or invalid is a miss.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSION = 1
KEY = ("config", "fingerprint", "tile_id")
BOXES = "array<struct<class_id:bigint,score:double,polygon:array<array<double>>>>"
LINE = f"struct<version:int,config:string,fingerprint:string,tile_id:string,predictions:{BOXES}>"


def _digest() -> Column:
    return F.sha2(F.to_json(F.struct(*KEY)), 256)


def _valid(predictions: Column) -> Column:
    """A class from 0, a score in [0, 1], four points of two finite numbers."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    point = lambda p: (F.size(p) == 2) & F.forall(p, finite)
    box = lambda b: (b["class_id"] >= 0) & b["score"].between(0, 1) & ~F.isnan(b["score"]) & (F.size(b["polygon"]) == 4) & F.forall(b["polygon"], point)
    return F.coalesce(predictions.isNotNull() & F.forall(predictions, lambda b: F.coalesce(box(b), F.lit(False))), F.lit(False))


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def save(entries: DataFrame, root: str) -> str:
    """Add entries (config, fingerprint, tile_id, predictions) as one batch; its name is returned. Invalid predictions raise, and leave nothing."""
    spark = entries.sparkSession
    name = f"batch-{time.time_ns():020d}-{uuid.uuid4().hex}"
    fine = F.when(_valid(F.col("predictions")) & F.col("tile_id").isNotNull() & (F.col("tile_id") != ""), F.col("predictions")).otherwise(F.raise_error(F.concat(F.lit("bad predictions of tile "), F.coalesce("tile_id", F.lit("null")))))
    body = F.to_json(F.struct(F.lit(VERSION).alias("version"), *KEY, fine.cast(BOXES).alias("predictions")))
    lines = entries.select(_digest().alias("d"), body.alias("b")).select(F.substring("d", 1, 2).alias("prefix"), F.concat_ws("\t", "d", F.sha2("b", 256), "b").alias("value"))
    staged = f"{root.rstrip('/')}/_{name}"
    fs, _ = _fs(spark, root)
    where = spark._jvm.org.apache.hadoop.fs.Path
    try:
        # a folder's lines meet in one task before they are written, so a batch is at most a file a folder and task
        lines.repartition("prefix").write.partitionBy("prefix").text(staged)
        if not fs.rename(where(staged), where(f"{root.rstrip('/')}/{name}")):
            raise OSError(f"could not put {name} in place")
    finally:
        fs.delete(where(staged), True)
    return name


def _folders(spark: SparkSession, root: str, prefixes: set[str]) -> list[str]:
    """The folders of all whole batches that hold entries of these prefixes."""
    fs, _ = _fs(spark, root)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/batch-*/prefix=*"))
    return sorted(str(s.getPath()) for s in found or [] if str(s.getPath().getName()).removeprefix("prefix=") in prefixes)


def load(tiles: DataFrame, root: str) -> DataFrame:
    """tiles (config, fingerprint, tile_id, ..) with their predictions, null where the cache has none that is whole."""
    spark = tiles.sparkSession
    keyed = tiles.withColumn("_d", _digest())
    prefixes = {r[0] for r in keyed.select(F.substring("_d", 1, 2)).distinct().collect()}  # at most 256
    folders = _folders(spark, root, prefixes)
    if not folders:
        return keyed.drop("_d").withColumn("predictions", F.lit(None).cast(BOXES))
    read = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(folders)
    part = F.split("value", "\t", 3)
    told = read.select(F.regexp_extract(F.col("_metadata.file_path"), "(batch-[0-9]+-[0-9a-f]+)", 1).alias("batch"), part.alias("p")).where(F.size("p") == 3)
    whole = told.where(F.sha2(F.col("p")[2], 256) == F.col("p")[1]).select("batch", F.col("p")[1].alias("_c"), F.col("p")[0].alias("_d"), F.from_json(F.col("p")[2], LINE).alias("e"))
    good = whole.where((F.col("e.version") == VERSION) & _valid(F.col("e.predictions")))
    latest = Window.partitionBy("_d").orderBy(F.desc("batch"), "_c")
    last = good.withColumn("_r", F.row_number().over(latest)).where("_r = 1")
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"e.{c}"))
    joined = keyed.join(last, "_d", "left")
    return joined.withColumn("predictions", F.when(same, F.col("e.predictions"))).drop("_d", "batch", "_c", "e", "_r")


def misses(tiles: DataFrame, root: str) -> DataFrame:
    """The tiles that the cache does not hold: what a detector still has to see."""
    return load(tiles, root).where("predictions is null").drop("predictions")
