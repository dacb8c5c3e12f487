"""Pairs of boxes that overlap, by cells.

A plane of boxes falls into grids of cells of side 4^k. A box has the level whose cells are just no smaller than it, so it lies in
at most four of them. It is dealt to its cells there and, to meet larger boxes, to those of each coarser level that some box of either side has
(few: sizes in one table span a handful of powers of four). Two boxes meet at the coarser of their levels, in each cell that they share,
and are kept in the one that holds the corner where their overlap begins. Boxes that cannot touch are thus hardly ever paired, and an
image with very many boxes is shared by as many tasks as it has cells.

Where only an IoU of t or more counts, the cells are those of the boxes' cores. Two boxes at that IoU share at least t / (1 + t)
of the sum of their areas. As across an axis they share no more than the shorter of their sides, along it they share at least t / (1 + t) of the sum
of their sides, so their centres are at most (1 - t) / (1 + t) of half that sum apart: boxes that much smaller about the same centres still meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.functions.geometry import BOX, hbb_iou

#: Sides are powers of this.
BASE = 4.0
CORNERS = ("lx", "ly", "hx", "hy")
#: Cores are no smaller than this part of their box.
CORE = 1 / 16


def _level(side: Column) -> Column:
    return F.ceil(F.log(BASE, side)).cast("int")


def _core(prefix: str, least: Column) -> dict[str, Column]:
    """The corners of a box's core for that IoU, a little larger so that rounding loses no pair, and inside the box."""
    part = F.greatest((1 - least) / (1 + least), F.lit(CORE))
    made = {}
    for axis in "xy":
        low, high = F.col(f"{prefix}l{axis}"), F.col(f"{prefix}h{axis}")
        cut = (high - low) * ((1 - part) / 2 - 1e-6) - F.greatest(F.abs(low), F.abs(high)) * 1e-14
        made |= {f"{prefix}cl{axis}": F.greatest(low, low + cut), f"{prefix}ch{axis}": F.least(high, high - cut)}
    return made


def _sided(df: DataFrame, on: list[str], prefix: str, also: tuple[str, ...] = (), least: bool = False) -> DataFrame:
    """df as a struct of its columns, with its ordered corners, those of its core (`least`: for the IoU in column _least; else the box) and level;
    boxes without extent or end overlap nothing and go."""
    low = [F.least(F.col(a), F.col(b)) for a, b in (("x1", "x2"), ("y1", "y2"))]
    high = [F.greatest(F.col(a), F.col(b)) for a, b in (("x1", "x2"), ("y1", "y2"))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_least"]).alias(f"{prefix}row")
    told = df.select(*on, row, *[v.cast("double").alias(f"{prefix}{c}") for v, c in zip((*low, *high), CORNERS)], *[F.col(c).alias(f"{prefix}{c}") for c in also], *(["_least"] if least else []))
    wide, high = F.col(f"{prefix}hx") - F.col(f"{prefix}lx"), F.col(f"{prefix}hy") - F.col(f"{prefix}ly")
    held = told.where((wide > 0) & (high > 0) & (F.abs(wide) < float("inf")) & (F.abs(high) < float("inf")))
    held = held.withColumns(_core(prefix, F.col("_least")) if least else {f"{prefix}c{c}": F.col(f"{prefix}{c}") for c in CORNERS}).drop("_least")
    return held.withColumn(f"{prefix}level", _level(F.greatest(F.col(f"{prefix}chx") - F.col(f"{prefix}clx"), F.col(f"{prefix}chy") - F.col(f"{prefix}cly"))))


def _dealt(side: DataFrame, levels: DataFrame, prefix: str) -> DataFrame:
    """A row per cell of its core, with its level and its corner of smallest coordinates. levels is one row, an array."""
    mine = side.withColumn("levels", levels.scalar()).withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col(f"{prefix}level")))).drop("levels")
    mine = mine.withColumn("cell", F.pow(F.lit(BASE), "level"))
    at = lambda c: F.floor(F.col(f"{prefix}c{c}") / F.col("cell"))
    across = mine.withColumn("cell_x", F.explode(F.sequence(at("lx"), at("hx"))))
    return across.withColumn("cell_y", F.explode(F.sequence(at("ly"), at("hy"))))


def overlapping_pairs(
    left: DataFrame, right: DataFrame, on: list[str], keep: tuple[list[str], list[str]] | None = None, share: float | None = None, least: tuple[Column, Column] | None = None
) -> DataFrame:
    """Structs l and r of the rows of left and right with equal `on` columns whose boxes (x1, y1, x2, y2; corners may be reversed)
    share area, with iou; each pair once. `keep` names the columns that the structs hold besides (all, if not given). `share`: pairs whose boxes
    share less than this part of the sum of their `size` columns are left out. `least`: for each side, a positive IoU; pairs below the greater one may be left out."""
    also = () if share is None else ("size",)
    if least:
        left, right = (df.withColumn("_least", v.cast("double")) for df, v in zip((left, right), least))
    if keep:
        left, right = (df.select(*dict.fromkeys([*on, *names, *BOX, *also, *(["_least"] if least else [])])) for df, names in zip((left, right), keep))
    a, b = _sided(left, on, "l_", also, bool(least)), _sided(right, on, "r_", also, bool(least))
    seen = a.select(F.col("l_level").alias("v")).unionByName(b.select(F.col("r_level").alias("v")))
    levels = seen.agg(F.collect_set("v").alias("levels"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*on, "level", "cell_x", "cell_y"]
    # a pair costs far more time than a row's bytes say, so the partitions are not merged by size
    dealt = _dealt(a, levels, "l_").repartition(n, *keys)
    pairs = dealt.join(_dealt(b, levels, "r_").drop("cell"), keys)
    wide, high = (F.least(f"l_h{v}", f"r_h{v}") - F.greatest(f"l_l{v}", f"r_l{v}") for v in "xy")
    lx, ly = (F.greatest(f"l_cl{v}", f"r_cl{v}") for v in "xy")
    cores = (lx <= F.least("l_chx", "r_chx")) & (ly <= F.least("l_chy", "r_chy"))
    # cells are powers of four wide, so these products are exact
    here = lambda v, c: (v >= F.col(c) * F.col("cell")) & (v < (F.col(c) + 1) * F.col("cell"))
    meet = cores & (F.greatest("l_level", "r_level") == F.col("level")) & here(lx, "cell_x") & here(ly, "cell_y")
    area = lambda p: (F.col(f"{p}hx") - F.col(f"{p}lx")) * (F.col(f"{p}hy") - F.col(f"{p}ly"))
    both = wide * high
    enough = F.lit(True) if share is None else both * (1 + 1e-6) >= share * (F.col("l_size") + F.col("r_size"))
    return pairs.where((wide > 0) & (high > 0) & meet & enough).select(F.col("l_row").alias("l"), F.col("r_row").alias("r"), (both / (area("l_") + area("r_") - both)).alias("iou"))


def pairs_at(left: DataFrame, right: DataFrame, on: list[str], iou: float, keep: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """As overlapping_pairs, those of at least that IoU. At 0 or less that is every pair with equal keys, touching or not."""
    if iou > 0:
        return overlapping_pairs(left, right, on, keep, least=(F.lit(float(iou)), F.lit(float(iou)))).where(F.col("iou") >= iou)
    a, b = (df.select(*on, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(s)) for df, s in ((left, "l"), (right, "r")))
    both = a.join(b, on).select("l", "r")
    return both.withColumn("iou", hbb_iou([F.col(f"l.{c}") for c in BOX], [F.col(f"r.{c}") for c in BOX])).where(F.col("iou") >= iou)
