"""Pairwise model mathematics as column expressions and joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import BOX, box
from boxwright.operators import spatial


def _centre_size(b: list[Column]) -> tuple[Column, Column, Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]


def gaussian_distance(a: list[Column], b: list[Column], eps: float = 1e-7) -> Column:
    """Gaussian combined distance of two boxes, seen as Gaussians, normalised by either's size and averaged."""
    ax, ay, aw, ah = _centre_size(a)
    bx, by, bw, bh = _centre_size(b)
    side = lambda w, h: ((ax - bx) / (w + eps)) ** 2 + ((ay - by) / (h + eps)) ** 2 + (((aw - bw) / (w + eps)) ** 2 + ((ah - bh) / (h + eps)) ** 2) / 4
    return (side(aw, ah) + side(bw, bh)) / 2


def gaussian_similarity(a: list[Column], b: list[Column], root_eps: float = 1e-12) -> Column:
    """1 for equal boxes; the root is softened near 0."""
    return F.exp(root_eps**0.5 - F.sqrt(gaussian_distance(a, b) + root_eps))


def dense_mask(boxes: DataFrame, scale: float, threshold: float, vehicle: int = 24) -> DataFrame:
    """boxes with dense: does any other vehicle of the image lie so near, in outline and in centre (over the mean diagonal), that
    exp(-distance / scale) exceeds the threshold? That bounds the distance, so sizes differ by less than the bound and centres by less
    than the bound times a diagonal no box of such a size exceeds: only boxes whose squares of that reach overlap are compared."""
    vehicles = boxes.where(F.col("class_id") == vehicle).select("image_id", "ord", *BOX)
    reach = -scale * math.log(threshold) if threshold > 0 else math.inf
    if reach <= 0:
        return boxes.withColumn("dense", F.lit(False))
    cx, cy, w, h = _centre_size(box())
    half = F.greatest(F.sqrt((F.abs(w) + reach / 2) ** 2 + (F.abs(h) + reach / 2) ** 2), F.lit(1e-4)) * (reach / 2) * (1 + 1e-9)
    told = vehicles.withColumn("b", F.struct(*BOX))
    squares = told.select("image_id", "ord", "b", (cx - half).alias("x1"), (cy - half).alias("y1"), (cx + half).alias("x2"), (cy + half).alias("y2"))
    pairs = spatial.overlapping_pairs(squares, squares, ["image_id"]) if math.isfinite(reach) else spatial.pairs_at(told, told, ["image_id"], 0.0)
    ax, ay, aw, ah = _centre_size([F.col(f"l.b.{c}") for c in BOX])
    bx, by, bw, bh = _centre_size([F.col(f"r.b.{c}") for c in BOX])
    outline = (aw - bw) ** 2 + (ah - bh) ** 2
    diagonal = ((aw + bw) / 2) ** 2 + ((ah + bh) / 2) ** 2
    apart = F.sqrt(outline + ((ax - bx) ** 2 + (ay - by) ** 2) / F.greatest(diagonal, F.lit(1e-9)))
    near = pairs.where((F.col("l.ord") != F.col("r.ord")) & (F.exp(-apart / scale) > threshold)).select("l.image_id", "l.ord")
    hit = near.select("image_id", "ord").distinct().withColumn("dense", F.lit(True))
    return boxes.join(hit, ["image_id", "ord"], "left").withColumn("dense", F.coalesce("dense", F.lit(False)))


def density_top_k(candidates: DataFrame, k: int) -> DataFrame:
    """candidates: (image_id, ord, candidate, affinity, dense). A dense box keeps its best candidate, others the best k."""
    w = Window.partitionBy("image_id", "ord").orderBy(F.desc("affinity"), "candidate")
    # the plain bound first: rows past it end before they are shuffled
    first = candidates.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(k, 1))
    return first.where(F.col("_r") <= F.when(F.col("dense"), 1).otherwise(k)).drop("_r")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


def hierarchical_loss(batch: DataFrame, levels: list[str], temperature: float, weights: list[float]) -> DataFrame:
    """Supervised contrastive loss over a batch (batch, id, vector, one label column per level), weighted over the levels.

    Per anchor: minus the mean over its positives of the log-softmax of its similarities to all others in the batch.
    A batch is what a training step holds; pairs are made within it.
    """
    v = batch.withColumn("vector", normalised(F.col("vector")))
    a = v.select("batch", F.col("id").alias("a"), F.col("vector").alias("va"), *[F.col(c).alias(f"a_{c}") for c in levels])
    b = v.select("batch", F.col("id").alias("b"), F.col("vector").alias("vb"), *[F.col(c).alias(f"b_{c}") for c in levels])
    pairs = a.join(b, "batch").where("a <> b").withColumn("s", dot(F.col("va"), F.col("vb")) / temperature)
    per = pairs.groupBy("batch", "a").agg(
        F.log(F.sum(F.exp("s"))).alias("z"),
        *[F.avg(F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), F.col("s"))).alias(f"m_{c}") for c in levels],
    )
    terms = [F.coalesce((F.col("z") - F.col(f"m_{c}")) * w, F.lit(0.0)) for c, w in zip(levels, weights, strict=True)]
    return per.groupBy("batch").agg(F.avg(sum(terms[1:], terms[0])).alias("loss"))


def update_prototypes(bank: DataFrame, batch: DataFrame, label: str, momentum: float) -> DataFrame:
    """bank: (label, vector). Each label's mean of the batch moves its prototype by 1 - momentum; the result is normalised."""
    place = batch.select(label, F.posexplode("vector").alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = place.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))
    joined = bank.join(means, label, "left")
    moved = F.zip_with("vector", "mean", lambda o, m: o * momentum + m * (1 - momentum))
    return joined.select(label, F.when(F.col("mean").isNull(), F.col("vector")).otherwise(normalised(moved)).alias("vector"))


def interpolate(left: DataFrame, right: DataFrame, alpha: float) -> DataFrame:
    """(name, place, value, is_float) tables: (1 - alpha) a + alpha b where floating, else a's value."""
    b = right.select("name", "place", F.col("value").alias("other"))
    mixed = F.when(F.col("is_float"), F.col("value") * (1 - alpha) + F.col("other") * alpha).otherwise(F.col("value"))
    return left.join(b, ["name", "place"]).select("name", "place", mixed.alias("value"), "is_float")
