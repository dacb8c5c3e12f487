"""Projections and filters over detections. Maps by class are small tables, broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import box, polygon, obb_to_hbb, clip_polygon, shift_polygon
from boxwright.operators.small import small
from boxwright.taxonomy import TAXONOMIES, coarse_of


def n_classes(taxonomy: str) -> int:
    return max(high for _, _, high in TAXONOMIES[taxonomy]) + 1


def over_class_threshold(detections: DataFrame, thresholds: DataFrame) -> DataFrame:
    """score >= the class's threshold; a class without one passes at 0."""
    joined = detections.join(small(thresholds), "class_id", "left")
    return joined.where(F.col("score") >= F.coalesce("threshold", F.lit(0.0))).select(*detections.columns)


def pipeline_filter(detections: DataFrame, thresholds: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """score >= the class's threshold; a class without one is dropped, an id outside the taxonomy raises."""
    ok = F.when(F.col("class_id").between(0, n_classes(taxonomy) - 1), F.lit(True)).otherwise(F.raise_error(F.lit("class outside the taxonomy")).cast("boolean"))
    joined = detections.where(ok).join(small(thresholds), "class_id")
    return joined.where(F.col("score") >= F.col("threshold")).select(*detections.columns)


def at_threshold(detections: DataFrame, threshold: float) -> DataFrame:
    return detections.where(F.col("score") >= threshold)


def at_ship_override(detections: DataFrame, general: float, ship: float, taxonomy: str = "scenes25") -> DataFrame:
    bound = F.when(coarse_of(F.col("class_id"), taxonomy) == "ship", F.lit(ship)).otherwise(F.lit(general))
    return detections.where(F.col("score") >= bound)


def box_area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def drop_low_and_small(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules: (class_id, min_score, min_area). A box goes only if it is under both."""
    joined = detections.join(small(rules), "class_id", "left")
    gone = F.coalesce((F.col("score") < F.col("min_score")) & (box_area() < F.col("min_area")), F.lit(False))
    return joined.where(~gone).select(*detections.columns)


def for_images(df: DataFrame, images: DataFrame) -> DataFrame:
    return df.join(images.select("image_id"), "image_id", "left_semi")


def inside_tile(margin: float) -> Column:
    """Tile-local boxes whose centre lies in the tile's valid area and that keep `margin` from edges inside the image (no such test at margin 0).
    Columns: x1..y2 in the tile; tile_x, tile_y, valid_width, valid_height; image_width, image_height."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    centred = (cx >= 0) & (cx < F.col("valid_width")) & (cy >= 0) & (cy < F.col("valid_height"))
    if not margin:
        return centred
    left = (F.col("tile_x") > 0) & (F.col("x1") < margin)
    top = (F.col("tile_y") > 0) & (F.col("y1") < margin)
    right = (F.col("tile_x") + F.col("valid_width") < F.col("image_width")) & (F.col("x2") > F.col("valid_width") - margin)
    bottom = (F.col("tile_y") + F.col("valid_height") < F.col("image_height")) & (F.col("y2") > F.col("valid_height") - margin)
    return centred & ~(left | top | right | bottom)


def to_image(detections: DataFrame) -> DataFrame:
    """Tile-local boxes moved to the image and held in [0, width] x [0, height]."""
    moved = shift_polygon(polygon(box()), F.col("tile_x").cast("double"), F.col("tile_y").cast("double"))
    held = clip_polygon(moved, F.col("image_width") + 1, F.col("image_height") + 1)
    sides = obb_to_hbb(F.col("_p"))
    return detections.withColumn("_p", held).withColumns(dict(zip(("x1", "y1", "x2", "y2"), sides, strict=True))).drop("_p")


def valid_annotation(p: Column, width: Column, height: Column) -> Column:
    """Finite points inside the image and an outline that encloses area."""
    from boxwright.functions.geometry import is_convex

    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    inside = F.forall(p, lambda q: finite(q["x"]) & finite(q["y"]) & (q["x"] >= 0) & (q["x"] <= width) & (q["y"] >= 0) & (q["y"] <= height))
    return inside & is_convex(p)


def remap_classes(df: DataFrame, mapping: dict[int, int]) -> DataFrame:
    out = F.col("class_id")
    for old, new in mapping.items():
        out = F.when(F.col("class_id") == old, F.lit(new)).otherwise(out)
    return df.withColumn("class_id", out.cast("int"))
