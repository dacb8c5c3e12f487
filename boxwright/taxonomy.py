"""The class taxonomies as small dimension tables (at most a few dozen rows, so always broadcast)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COARSE = ("aircraft", "ship", "vehicle")

#: Class ids by coarse class, from .. to inclusive.
TAXONOMIES = {
    "legacy3": (("aircraft", 0, 0), ("ship", 1, 1), ("vehicle", 2, 2)),
    "vehicle1": (("vehicle", 0, 0),),
    "scenes25": (("ship", 0, 3), ("aircraft", 4, 23), ("vehicle", 24, 24)),
}


def coarse_of(class_id: Column, taxonomy: str = "scenes25") -> Column:
    """Coarse class as an expression; null for an id outside the taxonomy."""
    out = F.lit(None).cast("string")
    for name, low, high in TAXONOMIES[taxonomy]:
        out = F.when(class_id.between(low, high), F.lit(name)).otherwise(out)
    return out


def checked_coarse(class_id: Column, taxonomy: str = "scenes25") -> Column:
    """As coarse_of, but an id outside the taxonomy raises."""
    known = coarse_of(class_id, taxonomy)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("class outside the taxonomy: "), class_id.cast("string"))).cast("string"))


def dimension(spark: SparkSession, taxonomy: str = "scenes25") -> DataFrame:
    """(class_id, coarse) of every class."""
    parts = [(low, high, name) for name, low, high in TAXONOMIES[taxonomy]]
    frame = spark.createDataFrame(parts, "low int, high int, coarse string")
    return frame.select(F.explode(F.sequence("low", "high")).alias("class_id"), "coarse")


def match_iou(class_id: Column, taxonomy: str = "scenes25") -> Column:
    """IoU that a match with a truth of this class needs: .35 for vehicles, .5 for others."""
    return F.when(coarse_of(class_id, taxonomy) == "vehicle", F.lit(0.35)).otherwise(F.lit(0.50))
