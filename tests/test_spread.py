"""Queries of little input and much work keep many tasks."""

from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import confirmer, kernels, rasters
from boxwright.plans import boxes
from boxwright.plans.registry import spread


def test_spread_after_a_shuffle_by_the_same_key(spark):
    few = spark.range(1000).select((F.col("id") % 400).alias("image_id")).distinct()
    assert spread(few, "image_id").select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_positions(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 64, 65, 112, 113, 400)], "n bigint").select("n", G.axis_positions(F.col("n"), F.lit(64), F.lit(48)).alias("at"))
    want = lambda n: [0] if n <= 64 else sorted({*range(0, n - 63, 48), n - 64})
    assert all(r["at"] == want(r["n"]) for r in rows.collect())
    assert "array_sort" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_top_candidates_are_bounded_before_the_shuffle(spark):
    c = spark.createDataFrame([(1, o, k, float(k % 5), o == 0) for o in range(3) for k in range(9)], "image_id bigint, ord bigint, candidate bigint, affinity double, dense boolean")
    found = kernels.density_top_k(c, 3)
    assert sorted((r["ord"], r["candidate"]) for r in found.collect()) == [(0, 4), (1, 3), (1, 4), (1, 8), (2, 3), (2, 4), (2, 8)]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_outlines_of_one_file(spark):
    assert boxes.g4_outlines(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_crops_of_few_images(spark):
    made = spark.createDataFrame([(f"crops/{i}.png", i, 1.0, 1.0, 9.0, 9.0) for i in range(200)], "crop string, image_id bigint, x1 double, y1 double, x2 double, y2 double")
    pictures = spark.createDataFrame([(i, 12, 12, 1, "uint8", bytearray(144)) for i in range(200)], rasters.RASTER.format(id="bigint")).repartition(4, "image_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = confirmer.crops(made, pictures, confirmer.CropPolicy(2.0, 4, 8, 4)).select(F.spark_partition_id().alias("p"), "crop").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == 200 and len({r["p"] for r in found}) == 4
