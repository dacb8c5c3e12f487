"""Box and polygon expressions. Boxes are four double columns (x1, y1, x2, y2); polygons are arrays of struct<x, y>.

All are built-in expressions, so a plan that uses them stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in BOX]


def _ordered(b: list[Column]) -> list[Column]:
    return [F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])]


def area(b: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])


def intersection(a: list[Column], b: list[Column]) -> Column:
    return area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])


def hbb_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; corners may be reversed; an empty union gives 0."""
    a, b = _ordered(a), _ordered(b)
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def diou(a: list[Column], b: list[Column]) -> Column:
    """IoU less the squared distance of centres over the squared diagonal of the hull; the centre term takes corners as given."""
    dx = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2
    dy = (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
    wide = F.greatest(a[2], b[2]) - F.least(a[0], b[0])
    high = F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    diagonal = wide * wide + high * high
    return hbb_iou(a, b) - F.when(diagonal > 0, (dx * dx + dy * dy) / diagonal).otherwise(F.lit(0.0))


def intersects(a: list[Column], b: list[Column]) -> Column:
    """Open intervals overlap on both axes: touching edges do not count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def polygon(b: list[Column]) -> Column:
    """Corners of a box: top left, top right, bottom right, bottom left."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(b[0], b[1]), point(b[2], b[1]), point(b[2], b[3]), point(b[0], b[3]))


def obb_to_hbb(p: Column) -> list[Column]:
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def clip_polygon(p: Column, width: Column, height: Column) -> Column:
    """Each point moved into [0, width - 1] x [0, height - 1]."""
    hold = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.greatest(top - 1, F.lit(0)).cast("double"))
    return F.transform(p, lambda q: F.struct(hold(q["x"], width).alias("x"), hold(q["y"], height).alias("y")))


def shift_polygon(p: Column, dx: Column, dy: Column) -> Column:
    return F.transform(p, lambda q: F.struct((q["x"] + dx).alias("x"), (q["y"] + dy).alias("y")))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def signed_area(p: Column) -> Column:
    """Shoelace formula; positive if the points run against the clock (y up)."""
    nxt = lambda i: F.get(p, (i + 1) % F.size(p))
    cross = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, i)["x"] * nxt(i)["y"] - nxt(i)["x"] * F.get(p, i)["y"])
    total = F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2
    return F.when(F.size(p) > 2, total).otherwise(F.lit(0.0))


def is_convex(p: Column) -> Column:
    """Four corners that all turn the same way (so the quadrilateral is simple and convex) and enclose area."""
    turns = [_turn(F.get(p, F.lit(i)), F.get(p, F.lit((i + 1) % 4)), F.get(p, F.lit((i + 2) % 4))) for i in range(4)]
    one_way = lambda op: op(turns[0]) & op(turns[1]) & op(turns[2]) & op(turns[3])
    whole = (F.size(p) == 4) & (one_way(lambda t: t >= 0) | one_way(lambda t: t <= 0))
    return whole & (F.abs(signed_area(p)) > 0)


def _clip_by_edge(points: Column, a: Column, b: Column) -> Column:
    """The part of a convex polygon to the left of the line a -> b (one step of Sutherland and Hodgman's clipping)."""

    def step(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, (i + 1) % F.size(points))
        s, t = _turn(a, b, p), _turn(a, b, q)
        cross = F.struct((p["x"] + (q["x"] - p["x"]) * s / (s - t)).alias("x"), (p["y"] + (q["y"] - p["y"]) * s / (s - t)).alias("y"))
        here = F.struct(p["x"].alias("x"), p["y"].alias("y"))
        none = F.filter(F.array(here), lambda _: F.lit(False))
        stays = F.when(s >= 0, F.array(here)).otherwise(none)
        cuts = F.when((s > 0) & (t < 0) | (s < 0) & (t > 0), F.array(cross)).otherwise(none)
        return F.concat(stays, cuts)

    ring = F.flatten(F.transform(F.sequence(F.lit(0), F.size(points) - 1), step))
    return F.when(F.size(points) > 0, ring).otherwise(points)


def polygon_iou(p: Column, q: Column) -> Column:
    """Exact area IoU of two convex quadrilaterals; 0 if either is invalid, self-intersecting or not convex."""
    ccw = lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r)

    def over(a: Column, b: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(b, i).alias("a"), F.get(b, (i + 1) % 4).alias("b")))
        common = F.aggregate(edges, a, lambda points, e: let(points, lambda r: _clip_by_edge(r, e["a"], e["b"])))

        def ratio(c: Column) -> Column:
            both = F.abs(signed_area(c))
            union = F.abs(signed_area(a)) + F.abs(signed_area(b)) - both
            return F.when(union > 0, both / union).otherwise(F.lit(0.0))

        return let(common, ratio)

    exact = let(ccw(p), lambda a: let(ccw(q), lambda b: over(a, b)))
    return F.when(is_convex(p) & is_convex(q), exact).otherwise(F.lit(0.0))


def axis_positions(length: Column, tile: Column, stride: Column) -> Column:
    """Starts 0, stride, 2 stride, ... of tiles that fit, and a last one flush with the end."""
    last = length - tile
    # the steps ascend, and only the last of them can be the flush one
    steps = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), stride.cast("bigint"))
    flush = F.when(F.element_at(steps, -1) < last, F.array(last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(length <= tile, F.array(F.lit(0).cast("bigint"))).otherwise(F.concat(steps, flush))


def tile_stride(tile: Column, overlap: Column) -> Column:
    """Half-even rounding, at least one."""
    return F.greatest(F.lit(1), F.bround(tile * (1 - overlap)).cast("int"))


def crop_origin_from_corners(low: Column, high: Column, crop: Column, limit: Column) -> Column:
    """Origin of a crop centred between two corners: (low + high - crop) / 2, rounded half-even, held inside."""
    return F.least(F.greatest(F.bround((low + high - crop) / 2).cast("int"), F.lit(0)), F.greatest(limit - crop, F.lit(0)))


def crop_origin_from_centre(centre: Column, crop: Column, limit: Column) -> Column:
    """Origin of a crop around a centre: centre - crop / 2, rounded half-even, held inside."""
    return F.least(F.greatest(F.bround(centre - crop / 2).cast("int"), F.lit(0)), F.greatest(limit - crop, F.lit(0)))


def crop_side(width: Column, height: Column, scale: float, least: int, most: int) -> Column:
    return F.least(F.greatest(F.bround(F.greatest(width, height) * scale).cast("int"), F.lit(least)), F.lit(most))


def crop_label(b: list[Column], crop: list[Column]) -> Column:
    """The box relative to a crop (left, top, right, bottom), clipped and normalised; null if its centre lies outside."""
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    inside = (cx >= crop[0]) & (cx < crop[2]) & (cy >= crop[1]) & (cy < crop[3])
    w, h = crop[2] - crop[0], crop[3] - crop[1]
    l, r = F.greatest(b[0], crop[0]) - crop[0], F.least(b[2], crop[2]) - crop[0]
    t, d = F.greatest(b[1], crop[1]) - crop[1], F.least(b[3], crop[3]) - crop[1]
    label = F.struct(((l + r) / 2 / w).alias("cx"), ((t + d) / 2 / h).alias("cy"), ((r - l) / w).alias("w"), ((d - t) / h).alias("h"))
    return F.when(inside & (r > l) & (d > t), label)
