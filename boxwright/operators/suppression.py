"""Suppression and fusion: ordered folds over the boxes of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import BOX, box, diou, hbb_iou, polygon
from boxwright.operators import folds, outlines
from boxwright.operators.small import small as small_table
from boxwright.taxonomy import coarse_of

FIELDS = ("image_id", "class_id", "ord", "score", *BOX)


def _structs(score_first: bool = True) -> list[Column]:
    return [(-F.col("score")).alias("s"), F.col("ord"), F.col("class_id"), *[F.col(c) for c in BOX]]


def _sides(item: Column) -> list[Column]:
    return [item[c] for c in BOX]


def _rows(grouped: DataFrame, kept: Column, keys: list[str]) -> DataFrame:
    out = grouped.select(*keys, F.explode(kept).alias("m"))
    return out.select(*[k for k in keys if k != "class_id"], F.col("m.class_id").alias("class_id"), F.col("m.ord").alias("ord"), (-F.col("m.s")).alias("score"), *[F.col(f"m.{c}").alias(c) for c in BOX])


def merge_detections(detections: DataFrame, iou: float, polygons: bool = False) -> DataFrame:
    """Non-maximum suppression per (image, class): a box goes if one kept before overlaps it (IoU over 0 and at least iou).
    With polygons, the box test comes first and only boxes that touch have their outlines compared."""

    if polygons:
        outlined = detections.withColumn("polygon", polygon(box()))
        return outlines.suppress_outlines(outlined, iou).select("image_id", "class_id", "ord", "score", *BOX)

    def clash(k: Column, x: Column) -> Column:
        rough = hbb_iou(_sides(k), _sides(x))
        return F.when(rough > 0, rough >= iou).otherwise(F.lit(False))

    grouped = folds.ordered(detections, ["image_id", "class_id"], _structs())
    return _rows(grouped, folds.accept_if_free(F.col("items"), clash), ["image_id", "class_id"])


def suppress_classes(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules: (class_id, method 'iou' or 'diou', threshold), one row a class and broadcast. A box goes if one kept before
    overlaps it by at least the threshold (at threshold 0 only the first stays). Classes without a rule are untouched."""
    ruled = detections.join(small_table(rules), "class_id")
    grouped = folds.ordered(ruled, ["image_id", "class_id", "method", "threshold"], _structs())
    overlap = lambda k, x: F.when(F.col("method") == "diou", diou(_sides(k), _sides(x))).otherwise(hbb_iou(_sides(k), _sides(x)))
    kept = _rows(grouped, folds.accept_if_free(F.col("items"), lambda k, x: overlap(k, x) >= F.col("threshold")), ["image_id", "class_id"])
    rest = detections.join(small_table(rules.select("class_id")), "class_id", "left_anti")
    return kept.unionByName(rest.select(*kept.columns))


def add_supplements(primary: DataFrame, supplements: DataFrame, iou: float) -> DataFrame:
    """Primary rows, and of the supplements by falling score those that overlap no row kept so far of the same image and coarse class."""
    tagged = primary.withColumn("rank", F.lit(0)).unionByName(supplements.withColumn("rank", F.lit(1)))
    tagged = tagged.withColumn("coarse", coarse_of(F.col("class_id")))
    grouped = folds.ordered(tagged, ["image_id", "coarse"], [F.col("rank"), *_structs()])
    clash = lambda k, x: (x["rank"] == 1) & (hbb_iou(_sides(k), _sides(x)) >= iou)
    return _rows(grouped, folds.accept_if_free(F.col("items"), clash), ["image_id", "coarse"]).drop("coarse").select(*FIELDS)


def select_coarse(detections: DataFrame, coarse: str, threshold: float) -> DataFrame:
    return detections.where((coarse_of(F.col("class_id")) == coarse) & (F.col("score") >= threshold))


def fuse_ranking(sources: dict[str, DataFrame], picks: dict[str, tuple[str, float]], supplement: tuple[str, float], iou: float) -> DataFrame:
    """For each coarse class the detections of the picked source over its threshold; vehicles of the supplement source are
    added where they overlap nothing kept."""
    chosen = [select_coarse(sources[name], coarse, t) for coarse, (name, t) in picks.items() if coarse != "vehicle"]
    name, t = picks["vehicle"]
    vehicles = add_supplements(select_coarse(sources[name], "vehicle", t), select_coarse(sources[supplement[0]], "vehicle", supplement[1]), iou)
    out = vehicles
    for part in chosen:
        out = out.unionByName(part.select(*FIELDS))
    return out


def fuse_multiscale(small: DataFrame, middle: DataFrame, large: DataFrame, thresholds: DataFrame, aircraft: tuple[float, float], ship: tuple[float, float], vehicle_min_score: float, vehicle_min_area: float) -> DataFrame:
    """Aircraft of the small scale with the middle's as supplements, ships of the large scale with the small's, vehicles of
    the large scale without those both low and small. Primary boxes pass their class's threshold (class_id, threshold; a class
    without one raises); `aircraft` and `ship` are the supplements' score bound and the IoU at which they are duplicates."""

    def over(df: DataFrame, coarse: str) -> DataFrame:
        joined = df.where(coarse_of(F.col("class_id")) == coarse).join(small_table(thresholds), "class_id", "left")
        bound = F.coalesce("threshold", F.raise_error(F.concat(F.lit("no threshold for class "), F.col("class_id").cast("string"))).cast("double"))
        return joined.where(F.col("score") >= bound).select(*FIELDS)

    planes = add_supplements(over(small, "aircraft"), select_coarse(middle, "aircraft", aircraft[0]).select(*FIELDS), aircraft[1])
    ships = add_supplements(over(large, "ship"), select_coarse(small, "ship", ship[0]).select(*FIELDS), ship[1])
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    vehicles = over(large, "vehicle").where(~((F.col("score") < vehicle_min_score) & (size < vehicle_min_area)))
    return planes.unionByName(ships).unionByName(vehicles)


def final_order(detections: DataFrame) -> DataFrame:
    """The order at the sink: image, class, falling score, place."""
    return detections.orderBy("image_id", "class_id", F.desc("score"), "ord")
