"""The tile cache, documents of ordered parts, and the prepare flow."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from boxwright.operators import prepare
from boxwright.sources import documents, tile_cache

ENTRY = f"config string, fingerprint string, tile_id string, predictions {tile_cache.BOXES}"
POLYGON = [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]


def entries(spark, n, score=0.5, first=0):
    return spark.createDataFrame([("c", "f", f"t{k}", [(k % 25, score, POLYGON)] * (k % 3)) for k in range(first, first + n)], ENTRY)


def scores(df):
    return {r["tile_id"]: None if r["predictions"] is None else [p["score"] for p in r["predictions"]] for r in df.collect()}


def test_cache_saves_and_loads(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    tiles = entries(spark, 30).drop("predictions").withColumn("extra", F.lit(1))
    assert set(scores(tile_cache.load(tiles, root)).values()) == {None}
    tile_cache.save(entries(spark, 20), root)
    got = scores(tile_cache.load(tiles, root))
    assert got == {f"t{k}": [0.5] * (k % 3) if k < 20 else None for k in range(30)}
    tile_cache.save(entries(spark, 5, 0.75, 10), root)
    assert scores(tile_cache.load(tiles, root)) == got | {f"t{k}": [0.75] * (k % 3) for k in range(10, 15)}
    assert {r["tile_id"] for r in tile_cache.misses(tiles, root).collect()} == {f"t{k}" for k in range(20, 30)}
    other = tiles.withColumn("fingerprint", F.lit("another image"))
    assert set(scores(tile_cache.load(other, root)).values()) == {None}


def test_damage_is_a_miss(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    tile_cache.save(entries(spark, 20), root)
    files = sorted(glob.glob(f"{tmp_path}/cache/batch-*/prefix=*/part-*"))
    lost = set()
    for k, name in enumerate(files[:6]):
        with open(name) as f:
            text = f.read()
        lost |= {json.loads(line.split("\t")[2])["tile_id"] for line in text.splitlines()}
        with open(name, "w") as f:
            f.write([text[: len(text) // 2 - 20], text.replace("0.5", "0.6").replace('"version":1', '"version":2'), "", "\x00\xff garbage", text.replace("\t", " "), text.replace('"tile_id":"t', '"tile_id":"u')][k])
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        os.path.exists(crc) and os.remove(crc)
    got = scores(tile_cache.load(entries(spark, 20).drop("predictions"), root))
    assert {t for t, s in got.items() if s is None} == lost and len(lost) < 20
    tile_cache.save(entries(spark, 20), root)  # what was lost is made again
    assert None not in scores(tile_cache.load(entries(spark, 20).drop("predictions"), root)).values()


def test_writers_beside_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/cache"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: tile_cache.save(entries(spark, 10, 0.5, 5 * k), root), range(4)))
    assert scores(tile_cache.load(entries(spark, 25).drop("predictions"), root)) == {f"t{k}": [0.5] * (k % 3) for k in range(25)}
    assert not glob.glob(f"{tmp_path}/cache/_batch*")


@pytest.mark.parametrize("bad", [(-1, 0.5, POLYGON), (0, 1.5, POLYGON), (0, float("nan"), POLYGON), (0, 0.5, POLYGON[:3]), (0, 0.5, [[0.0, float("inf")]] * 4), (None, 0.5, POLYGON)])
def test_bad_predictions_leave_nothing(spark, tmp_path, bad):
    with pytest.raises(Exception, match="bad predictions"):
        tile_cache.save(spark.createDataFrame([("c", "f", "t", [bad])], ENTRY), f"file://{tmp_path}/cache")
    assert not glob.glob(f"{tmp_path}/cache/*batch*")


def text_of(spark, folder):
    out = ""
    for name in documents.parts(spark, folder):
        with open(name.removeprefix("file:")) as f:
            out += f.read()
    return out


def test_manifests_of_ordered_parts(spark, tmp_path):
    n = 5000
    rows = spark.range(n).select(F.concat(F.lit("s"), F.sha2(F.col("id").cast("string"), 256)).alias("stem"), F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be written as one
    try:
        names = documents.write_manifests(rows, f"file://{tmp_path}/m")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for split, k in (("val", n // 4), ("train", n - n // 4)):
        lines = text_of(spark, f"file://{tmp_path}/m/{split}.txt").splitlines()
        assert lines == sorted(lines) and len(lines) == k
    assert len(names["train"]) > 1
    documents.write_manifests(rows.limit(10), f"file://{tmp_path}/m")  # again, over the old
    assert not glob.glob(f"{tmp_path}/m/*.part")
    assert documents.joined(spark, f"file://{tmp_path}/m/train.txt", f"file://{tmp_path}/one.txt") in (True, False)


def test_objects_of_ordered_parts(spark, tmp_path):
    folder = f"file://{tmp_path}/groups.json"
    rows = spark.createDataFrame([(f's"{k}\\', f"g{k % 3}", "val" if k % 2 else "train") for k in range(50)], "stem string, group_id string, split string")
    documents.write_source_groups(rows, folder)
    assert json.loads(text_of(spark, folder)) == {f's"{k}\\': {"group": f"g{k % 3}", "split": "val" if k % 2 else "train"} for k in range(50)}
    documents.write_source_groups(rows.limit(0), folder)
    assert json.loads(text_of(spark, folder)) == {}
    with pytest.raises(ValueError):
        documents.write_source_groups(rows.unionByName(rows.limit(1)), folder)


def test_arrays_of_ordered_parts(spark, tmp_path):
    folder = f"file://{tmp_path}/coco.json"
    rows = spark.range(60).select((F.col("id") % 7).alias("image_id"), F.col("id").alias("ord"), F.lit(3).alias("category_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox"), (F.col("id") / 100).alias("score"))
    documents.write_coco(rows.repartition(4), folder)
    got = json.loads(text_of(spark, folder))
    assert [(g["image_id"], g["score"]) for g in got] == [(i, k / 100) for i in range(7) for k in range(i, 60, 7)] and got[0]["bbox"] == [1.0, 2.0, 3.0, 4.0]
    documents.write_coco(rows.limit(0), folder)
    assert json.loads(text_of(spark, folder)) == []


def source(spark, groups=40):
    images = [(f"scene{g}_crop{k}", 100, 80, "RGB") for g in range(groups) for k in range(1 + g % 3)]
    labels = [(s, g % 5, o, 1.0, 2.0, 30.0, 40.0, False) for s, *_ in images for g in [int(s[5:].split("_")[0])] for o in range(1 + g % 2)]
    return (
        spark.createDataFrame(images, "stem string, width int, height int, mode string"),
        spark.createDataFrame(labels, "stem string, class_id int, ord bigint, x1 double, y1 double, x2 double, y2 double, difficult boolean"),
    )


def listed(folder):
    return {os.path.relpath(p, folder) for p in glob.glob(f"{folder}/**", recursive=True) if "part-" not in p and ".crc" not in p}


def test_prepare(spark, tmp_path):
    images, labels = source(spark)
    one, two = (prepare.prepare(images, labels, f"file://{tmp_path}/{n}", 0.15, 42) for n in ("first", "second"))
    split = lambda p: {r["stem"]: r["split"] for r in p.images.collect()}
    assert split(one) == split(two) and set(split(one).values()) == {"train", "val"}
    groups = {}
    for r in one.images.collect():
        groups.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in groups.values())
    for s in ("train", "val"):
        lines = text_of(spark, f"file://{tmp_path}/first/manifests/{s}.txt").splitlines()
        assert lines == [f"images/{s}/{stem}.jpg" for stem in sorted(k for k, v in split(one).items() if v == s)]
    assert text_of(spark, f"file://{tmp_path}/first/manifests/val-reviewed-core.txt") == ""
    told = json.loads(text_of(spark, f"file://{tmp_path}/first/source-groups.json"))
    assert told == {r["stem"]: {"group": r["group_id"], "split": r["split"]} for r in one.images.collect()}
    report = json.loads(text_of(spark, f"file://{tmp_path}/first/analysis.json"))
    assert report == one.report and report["split"]["group_overlap"] == 0 and report["source"]["images"] == len(told)
    assert sum(report["split"][s]["images"] for s in ("train", "val")) == len(told)
    assert not glob.glob(f"{tmp_path}/*stage*") and not glob.glob(f"{tmp_path}/*backup*")


def test_review_and_duplicates(spark, tmp_path):
    images, labels = source(spark)
    reviewed = spark.createDataFrame([("scene3_crop0", 2, 0, 5.0, 5.0, 9.0, 9.0, False), ("scene4_crop1", None, None, None, None, None, None, None)], labels.schema)
    pairs = spark.createDataFrame([("scene3_crop0", " scene10_crop0"), ("scene10_crop1", "scene20_crop0")], "left string, right string")
    made = prepare.prepare(images, labels, f"file://{tmp_path}/d", 0.2, 1, reviewed, pairs)
    rows = {r["stem"]: r for r in made.images.collect()}
    assert {rows[f"scene{g}_crop0"]["group_id"] for g in (3, 10, 20)} == {"scene10"} and {rows[f"scene{g}_crop0"]["split"] for g in (3, 10, 20, 4)} == {"val"}
    own = made.labels.where("stem = 'scene3_crop0'").collect()
    assert [(r["class_id"], r["x2"]) for r in own] == [(2, 9.0)] and made.labels.where("stem = 'scene4_crop1'").count() == 0
    assert text_of(spark, f"file://{tmp_path}/d/manifests/val-reviewed-core.txt").splitlines() == ["images/val/scene3_crop0.jpg", "images/val/scene4_crop1.jpg"]
    with pytest.raises(Exception, match="without image"):
        prepare.prepare(images, labels, f"file://{tmp_path}/e", reviewed=reviewed.withColumn("stem", F.lit("nowhere")))
    assert not os.path.exists(f"{tmp_path}/e")


def test_a_failing_validation_brings_the_old_set_back(spark, tmp_path):
    images, labels = source(spark)
    old = prepare.prepare(images, labels, f"file://{tmp_path}/d", 0.15, 42)
    before, files = sorted(map(tuple, old.images.collect())), listed(f"{tmp_path}/d")

    def fails(folder):
        assert spark.read.parquet(f"{folder}/images").where("split = 'val'").count() > 0  # the new one is in place
        raise RuntimeError("not this one")

    with pytest.raises(RuntimeError, match="not this one"):
        prepare.prepare(images, labels, f"file://{tmp_path}/d", 0.3, 7, check=fails)
    spark.catalog.refreshByPath(f"file://{tmp_path}/d")
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/d/images").collect())) == before and listed(f"{tmp_path}/d") == files
    assert not glob.glob(f"{tmp_path}/*stage*") and not glob.glob(f"{tmp_path}/*backup*")
    os.makedirs(f"{tmp_path}/mine")
    with pytest.raises(FileExistsError):
        prepare.prepare(images, labels, f"file://{tmp_path}/mine")
    assert os.listdir(f"{tmp_path}/mine") == []
    with pytest.raises(ValueError, match="given twice"):
        prepare.prepare(images.unionByName(images.limit(1)), labels, f"file://{tmp_path}/x")
