"""Dataset curation: ranks, quotas, mining and resampling decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import BOX, box, intersects
from boxwright.operators import matching, spatial
from boxwright.sources import scratch
from boxwright.taxonomy import coarse_of


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; order must end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def clear_of_truth(crops: DataFrame, truth: DataFrame) -> DataFrame:
    """Crops (image_id, x1..y2) that intersect no truth of their image."""
    t = truth.where(~F.col("difficult")).select(F.col("image_id").alias("t_image"), *[F.col(c).alias(f"t_{c}") for c in BOX])
    return crops.join(t, (F.col("image_id") == F.col("t_image")) & intersects(box(), box("t_")), "left_anti")


def quota_then_reject(crops: DataFrame, truth: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Top n per group first; crops that touch a truth go afterwards, and have used up quota."""
    return clear_of_truth(top_per(crops, group, order, n), truth)


def reject_then_quota(crops: DataFrame, truth: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Crops that touch a truth go first; the quota counts what is left."""
    return top_per(clear_of_truth(crops, truth), group, order, n)


def ids_by_name(df: DataFrame, name: str, out: str = "id") -> DataFrame:
    """1, 2, ... in order of the name, without a global window: the rows are range-partitioned by name, counted per
    partition, and each partition starts where those before it end (as many offsets as partitions, broadcast). The ranges come
    from a sample and may differ when they are made again, so the rows are written once with their partition's number."""
    ranged = scratch.cut(df.repartitionByRange(F.col(name)).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_p").orderBy(name)
    return ranged.withColumn("_r", F.row_number().over(within)).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_o") + F.col("_r")).drop("_p", "_r", "_o")


def fill_quota(df: DataFrame, keys: list[str], positive: Column, ratio: float, order: list[Column]) -> DataFrame:
    """All positives of each group and, in order, as many others as ceil(positives x ratio)."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_pos", positive).withColumn("_want", F.ceil(F.sum(F.col("_pos").cast("int")).over(w) * ratio))
    nth = F.row_number().over(Window.partitionBy(*keys, "_pos").orderBy(*order))
    return ranked.withColumn("_r", nth).where(F.col("_pos") | (F.col("_r") <= F.col("_want"))).drop("_pos", "_want", "_r")


def aliases(df: DataFrame, stem: str, suffix: str, order: list[Column], out: str = "alias") -> DataFrame:
    """stem__suffix01, 02, ... within each stem."""
    nth = F.row_number().over(Window.partitionBy(stem).orderBy(*order))
    return df.withColumn(out, F.concat(F.col(stem), F.lit(f"__{suffix}"), F.format_string("%02d", nth)))


def repeat(df: DataFrame, stem: str, factor: Column, suffix: str, out: str = "alias") -> DataFrame:
    """Each row `factor` times: itself, then aliases numbered from 1."""
    copies = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(factor, F.lit(1)) - 1)))
    return copies.withColumn(out, F.when(F.col("_i") == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit(f"__{suffix}"), F.format_string("%02d", F.col("_i"))))).drop("_i")


def demo_samples(annotations: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    return annotations.groupBy(coarse_of(F.col("class_id"), taxonomy).alias("coarse")).agg(F.min("stem").alias("stem"))


def class_frequency(classes: Column, factors: dict[int, int]) -> Column:
    """How often an image is used: the greatest factor of the classes (an array) that it shows, else once."""
    return F.greatest(F.lit(1), *[F.when(F.array_contains(classes, c), F.lit(k)).otherwise(F.lit(1)) for c, k in factors.items()], F.lit(1))


def hard_negatives(detections: DataFrame, truth: DataFrame, images: DataFrame, min_score: float, size: int, margin: float, per_group: int, seed: int = 42, taxonomy: str = "scenes25") -> DataFrame:
    """Crops around confident ship and vehicle detections that match no truth of their coarse class, and that, widened by a margin,
    touch no truth at all; the best of each source group. images: image_id, stem, group_id, width, height."""
    from boxwright.functions.geometry import crop_origin_from_corners
    from boxwright.taxonomy import match_iou

    coarse = coarse_of(F.col("class_id"), taxonomy)
    t = truth.where(~F.col("difficult")).select(F.col("image_id").alias("t_image"), coarse.alias("t_coarse"), *[F.col(c).alias(f"t_{c}") for c in BOX])
    sure = detections.withColumn("coarse", coarse).where(F.col("coarse").isin("ship", "vehicle") & (F.col("score") >= min_score))
    near = spatial.overlapping_pairs(sure, truth.where(~F.col("difficult")).withColumn("coarse", coarse), ["image_id", "coarse"], (["ord", "class_id"], []))
    found = near.where(F.col("iou") >= match_iou(F.col("l.class_id"), taxonomy)).select("l.image_id", "l.ord").distinct()
    loose = sure.join(found, ["image_id", "ord"], "left_anti").join(images, "image_id")
    side = lambda c: F.least(F.lit(size), F.col(c))
    left = crop_origin_from_corners(F.col("x1"), F.col("x2"), side("width"), F.col("width"))
    top = crop_origin_from_corners(F.col("y1"), F.col("y2"), side("height"), F.col("height"))
    crops = loose.select("image_id", "stem", "group_id", "ord", "score", "coarse", left.alias("x1"), top.alias("y1"), (left + side("width")).alias("x2"), (top + side("height")).alias("y2"))
    wide = [F.col("x1") - margin, F.col("y1") - margin, F.col("x2") + margin, F.col("y2") + margin]
    clear = crops.join(t, (F.col("image_id") == F.col("t_image")) & intersects(wide, box("t_")), "left_anti")
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), "stem", F.col("ord").cast("string")), 256)
    return top_per(clear, ["group_id"], [F.desc("score"), rank], per_group)


def _crop(df: DataFrame, size: int) -> DataFrame:
    """The box replaced by a crop around its centre, held inside the image (width, height)."""
    from boxwright.functions.geometry import crop_origin_from_centre

    w, h = F.least(F.lit(size), F.col("width")), F.least(F.lit(size), F.col("height"))
    left = crop_origin_from_centre((F.col("x1") + F.col("x2")) / 2, w, F.col("width"))
    top = crop_origin_from_centre((F.col("y1") + F.col("y2")) / 2, h, F.col("height"))
    made = df.select("*", left.alias("_l"), top.alias("_t"), w.alias("_w"), h.alias("_h"))
    sides = {"x1": F.col("_l"), "y1": F.col("_t"), "x2": F.col("_l") + F.col("_w"), "y2": F.col("_t") + F.col("_h")}
    return made.withColumns({k: v.cast("double") for k, v in sides.items()}).drop("_l", "_t", "_w", "_h")


def _seeded(seed: int, kind: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(kind), "stem", F.col("ord").cast("string")), 256)


def hard_examples(detections: DataFrame, truth: DataFrame, images: DataFrame, per_positive: int, per_negative: int, floor: float, size: int, seed: int = 42, taxonomy: str = "scenes25") -> DataFrame:
    """Ship and vehicle truths that were missed (smallest first) and confident unmatched detections that touch no truth (best
    first), with caps per group and coarse class; negatives whose crop touches a truth go after the cap. size 0: no crops."""
    found = matching.greedy_match(detections, truth, ("coarse",), taxonomy)
    wanted = lambda df: df.withColumn("coarse", coarse_of(F.col("class_id"), taxonomy)).where(F.col("coarse").isin("ship", "vehicle"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    missed = wanted(truth.where(~F.col("difficult"))).join(found.select("image_id", F.col("t_ord").alias("ord")), ["image_id", "ord"], "left_anti").join(images, "image_id")
    positive = top_per(missed.withColumn("score", F.lit(None).cast("double")), ["group_id", "coarse"], [area, _seeded(seed, "positive")], per_positive)
    false = wanted(detections).where(F.col("score") >= floor).join(found.select("image_id", F.col("p_ord").alias("ord")), ["image_id", "ord"], "left_anti")
    negative = top_per(clear_of_truth(false, truth).join(images, "image_id"), ["group_id", "coarse"], [F.desc("score"), _seeded(seed, "negative")], per_negative)
    if size:
        positive, negative = _crop(positive, size), clear_of_truth(_crop(negative, size), truth)
    columns = ["image_id", "stem", "group_id", "coarse", "ord", "score", *BOX]
    return positive.select(F.lit("positive").alias("kind"), *columns).unionByName(negative.select(F.lit("negative").alias("kind"), *columns))


def expert_crops(proposals: DataFrame, truth: DataFrame, images: DataFrame, size: int, floor: float, per_group: int, ratio: float, seed: int = 42, vehicle: int = 24) -> DataFrame:
    """A crop for every vehicle truth; for confident background proposals whose crop touches no vehicle, at most per_group of a
    source group; and, up to ceil(positives x ratio) negatives, one from images without vehicles, in order of a seeded rank."""
    vehicles = truth.where((F.col("class_id") == vehicle) & ~F.col("difficult"))
    columns = ["image_id", "stem", "group_id", "ord", "score", *BOX]
    positive = _crop(vehicles.withColumn("score", F.lit(1.0)).join(images, "image_id"), size).select(F.lit("positive").alias("kind"), *columns)
    labelled = matching.label_proposals(proposals.where("false"), proposals, truth, vehicle)
    loose = labelled.where((F.col("reason") == "background") & (F.col("score") >= floor)).join(images, "image_id")
    # read twice: counted, and given
    negative = scratch.cut(reject_then_quota(_crop(loose, size), vehicles, ["group_id"], [F.desc("score"), F.col("ord")], per_group).select(F.lit("negative").alias("kind"), *columns))
    missing = -(-vehicles.count() * ratio // 1) - negative.count()
    left, top = (_fill_origin(c, seed, size, part) for c, part in (("width", 1), ("height", 17)))
    empty = images.join(vehicles.select("image_id"), "image_id", "left_anti").orderBy(F.sha2(F.concat(F.lit(f"{seed}:fill:"), "stem"), 256)).limit(max(0, int(missing)))
    fill = empty.select(
        F.lit("fill").alias("kind"), "image_id", "stem", "group_id", F.lit(None).cast("bigint").alias("ord"), F.lit(0.0).alias("score"), left.alias("x1"), top.alias("y1"),
        (left + F.least(F.lit(size), F.col("width"))).alias("x2"), (top + F.least(F.lit(size), F.col("height"))).alias("y2"),
    )
    return positive.unionByName(negative).unionByName(fill)


def _fill_origin(side: str, seed: int, size: int, at: int) -> Column:
    """Eight bytes of the image's digest, unsigned, modulo the origins that fit."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:background:"), "stem"), 256), at, 16), 16, 10).cast("decimal(20,0)")
    return (head % (F.col(side) - F.least(F.lit(size), F.col(side)) + 1).cast("decimal(20,0)")).cast("double")


def duplicate_components(pairs: DataFrame, nodes: DataFrame, key: str = "stem", max_rounds: int = 40) -> DataFrame:
    """(key, canonical): the smallest key reachable over the pairs (left, right). Minimum labels spread with pointer
    jumping, each round written out, so lineage stays short; rounds grow with the logarithm of a chain's length."""
    from boxwright.sources.scratch import cut

    # both directions out of one run of the pairs
    ways = F.array(F.struct(F.col("left").alias("a"), F.col("right").alias("b")), F.struct(F.col("right").alias("a"), F.col("left").alias("b")))
    edges = cut(pairs.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    label = cut(nodes.select(F.col(key).alias("k"), F.col(key).alias("c")).distinct())
    for _ in range(max_rounds):
        near = edges.join(label, edges["b"] == label["k"]).groupBy("a").agg(F.min("c").alias("m"))
        step = label.join(near, label["k"] == near["a"], "left").select("k", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = step.select(F.col("k").alias("j"), F.col("c").alias("jc"))
        after = cut(step.join(jump, step["c"] == jump["j"], "left").select("k", F.least("c", F.coalesce("jc", "c")).alias("c")))
        changed = after.join(label.withColumnRenamed("c", "old"), "k").where("c <> old").limit(1).count()
        label = after
        if not changed:
            return label.select(F.col("k").alias(key), F.col("c").alias("canonical"))
    raise RuntimeError("duplicate groups did not settle")


def confirmer_features(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Scalar features of labelled proposals: width and height over the image's, and the score."""
    joined = labelled.join(sizes, "image_id")
    return joined.select("image_id", "ord", "label", "reason", "score", ((F.col("x2") - F.col("x1")) / F.col("width")).alias("width_norm"), ((F.col("y2") - F.col("y1")) / F.col("height")).alias("height_norm"))


def iou_existence(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left with a flag: does any right box of its image reach that IoU?"""
    hit = spatial.pairs_at(left, right, ["image_id"], least, (["ord"], [])).select("l.image_id", "l.ord").distinct().withColumn("hit", F.lit(True))
    return left.join(hit, ["image_id", "ord"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
