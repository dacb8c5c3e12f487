"""Polygons of any simple outline: area, validity, IoU, and suppression by it.

The plane is cut by horizontal lines through every corner and every crossing of two edges. Between two lines no edge meets another, so what
two outlines share there are trapezoids, each as wide in the middle as on average. An outline counts only if no two of its edges meet but neighbours at
their corner, and it encloses area; others have IoU 0 with everything, as outlines without area have.

Polygons are arrays of struct<x, y>, open or closed, in either direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.operators import spatial


def ring(points: np.ndarray) -> np.ndarray:
    """The corners without repeats of the one before."""
    points = np.asarray(points, float).reshape(-1, 2)
    return points[(points != np.roll(points, 1, axis=0)).any(axis=1)] if len(points) else points


def _edges(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return r, np.roll(r, -1, axis=0)


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _between(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Is c, on the line of a and b, within their box?"""
    return ((np.minimum(a, b) <= c) & (c <= np.maximum(a, b))).all(axis=-1)


def is_simple(r: np.ndarray) -> bool:
    """No two edges of the ring meet, but neighbours at their corner."""
    n = len(r)
    if n < 3 or not np.isfinite(r).all():
        return False
    a, b = _edges(r)
    i, j = np.triu_indices(n, 1)
    beside = (j - i == 1) | (j - i == n - 1)
    p, q, s, t = a[i], b[i], a[j], b[j]
    d1, d2, d3, d4 = _turn(p, q, s), _turn(p, q, t), _turn(s, t, p), _turn(s, t, q)
    cross = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
    touch = ((d1 == 0) & _between(p, q, s)) | ((d2 == 0) & _between(p, q, t)) | ((d3 == 0) & _between(s, t, p)) | ((d4 == 0) & _between(s, t, q))
    if ((cross | touch) & ~beside).any():
        return False
    # neighbours share a corner; they must not run back over each other
    back = (_turn(np.roll(r, 1, axis=0), r, b) == 0) & (((np.roll(r, 1, axis=0) - r) * (b - r)).sum(axis=1) > 0)
    return not back.any()


def area(r: np.ndarray) -> float:
    a, b = _edges(r - r[0])
    return abs(float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum())) / 2


def _crossing_heights(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    a, b = (e[:, None] for e in _edges(r))
    c, d = (e[None] for e in _edges(s))
    across, down = b - a, d - c
    slope = across[..., 0] * down[..., 1] - across[..., 1] * down[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = ((c - a)[..., 0] * down[..., 1] - (c - a)[..., 1] * down[..., 0]) / slope
        v = ((c - a)[..., 0] * across[..., 1] - (c - a)[..., 1] * across[..., 0]) / slope
        y = a[..., 1] + u * across[..., 1]
    return y[(slope != 0) & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)]


def _spans(r: np.ndarray, y: float) -> np.ndarray:
    """The x at which the edges cross a height that is no corner's, ascending: inside lies between the first two, the next two, ..."""
    a, b = _edges(r)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    return np.sort(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))


def shared_area(r: np.ndarray, s: np.ndarray) -> float:
    low, high = max(r[:, 1].min(), s[:, 1].min()), min(r[:, 1].max(), s[:, 1].max())
    if low >= high:
        return 0.0
    lines = np.unique(np.concatenate([[low, high], r[:, 1], s[:, 1], _crossing_heights(r, s)]))
    lines = lines[(lines >= low) & (lines <= high)]
    total = 0.0
    for bottom, top in zip(lines[:-1], lines[1:]):
        one, two = _spans(r, (bottom + top) / 2).reshape(-1, 2), _spans(s, (bottom + top) / 2).reshape(-1, 2)
        wide = np.minimum(one[:, None, 1], two[None, :, 1]) - np.maximum(one[:, None, 0], two[None, :, 0])
        total += float(np.maximum(wide, 0).sum()) * float(top - bottom)
    return total


def outline_iou(p: np.ndarray, q: np.ndarray) -> float:
    r, s = ring(p), ring(q)
    if not (is_simple(r) and is_simple(s)):
        return 0.0
    one, two = area(r), area(s)
    both = min(shared_area(r, s), one, two)
    return both / (one + two - both) if one > 0 and two > 0 else 0.0


#: Numbers in the largest array of a batch of pairs.
CELLS = 1 << 20


def _rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All corners without repeats of the one before, and where each row's begin and how many they are (none where null)."""
    flat, ends = column.values, column.offsets.to_numpy().astype(np.int64)
    xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)[ends[0] : ends[-1]]
    first, size = ends[:-1] - ends[0], np.diff(ends)
    before, held = np.arange(len(xy)) - 1, size > 0
    before[first[held]] = (first + size - 1)[held]
    kept = (xy != xy[before]).any(axis=1)
    until = np.concatenate([[0], np.cumsum(kept)])
    start = until[first]
    return xy[kept], start, np.where(column.is_valid().to_numpy(zero_copy_only=False), until[first + size] - start, 0)


def _simple_rows(r: np.ndarray) -> np.ndarray:
    """is_simple of rings with as many corners each: (rings, corners, 2)."""
    n = r.shape[1]
    if n < 3:
        return np.zeros(len(r), bool)
    finite = np.isfinite(r).all(axis=(1, 2))
    r = np.where(finite[:, None, None], r, 0.0)
    a, b, c = r, np.roll(r, -1, axis=1), np.roll(r, 1, axis=1)
    i, j = np.triu_indices(n, 1)
    beside = (j - i == 1) | (j - i == n - 1)
    i, j = i[~beside], j[~beside]
    p, q, s, t = a[:, i], b[:, i], a[:, j], b[:, j]
    d1, d2, d3, d4 = _turn(p, q, s), _turn(p, q, t), _turn(s, t, p), _turn(s, t, q)
    cross = (np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0)
    touch = ((d1 == 0) & _between(p, q, s)) | ((d2 == 0) & _between(p, q, t)) | ((d3 == 0) & _between(s, t, p)) | ((d4 == 0) & _between(s, t, q))
    back = (_turn(c, r, b) == 0) & (((c - r) * (b - r)).sum(axis=2) > 0)
    return finite & ~(cross | touch).any(axis=1) & ~back.any(axis=1)


def _area_rows(r: np.ndarray) -> np.ndarray:
    a = r - r[:, :1]
    b = np.roll(a, -1, axis=1)
    return np.abs((a[..., 0] * b[..., 1] - b[..., 0] * a[..., 1]).sum(axis=1)) / 2


def _spans_rows(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_spans of every ring at its own height, with infinity after the last."""
    a, b = r, np.roll(r, -1, axis=1)
    over = (a[..., 1] > y[:, None]) != (b[..., 1] > y[:, None])
    down = np.where(over, b[..., 1] - a[..., 1], 1.0)
    return np.sort(np.where(over, a[..., 0] + (y[:, None] - a[..., 1]) / down * (b[..., 0] - a[..., 0]), np.inf), axis=1)


def _shared_rows(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """shared_area of rows of rings. Lines that a row does not have lie at its top, where strips have no height."""
    rows = len(r)
    low, high = np.maximum(r[..., 1].min(axis=1), s[..., 1].min(axis=1)), np.minimum(r[..., 1].max(axis=1), s[..., 1].max(axis=1))
    a, b = r[:, :, None], np.roll(r, -1, axis=1)[:, :, None]
    c, d = s[:, None], np.roll(s, -1, axis=1)[:, None]
    across, down = b - a, d - c
    slope = across[..., 0] * down[..., 1] - across[..., 1] * down[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        u = ((c - a)[..., 0] * down[..., 1] - (c - a)[..., 1] * down[..., 0]) / slope
        v = ((c - a)[..., 0] * across[..., 1] - (c - a)[..., 1] * across[..., 0]) / slope
        y = a[..., 1] + u * across[..., 1]
    y = np.where((slope != 0) & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1), y, np.inf)
    lines = np.concatenate([low[:, None], r[..., 1], s[..., 1], y.reshape(rows, r.shape[1] * s.shape[1])], axis=1)
    lines = np.sort(np.where((lines >= low[:, None]) & (lines < high[:, None]), lines, np.inf), axis=1)
    lines[:, 1:][lines[:, 1:] == lines[:, :-1]] = np.inf
    lines.sort(axis=1)
    lines = np.minimum(lines[:, : int(np.isfinite(lines).sum(axis=1).max(initial=0))], high[:, None])
    lines = np.concatenate([lines, high[:, None]], axis=1)
    total = np.zeros(rows)
    for k in range(lines.shape[1] - 1):
        at = np.flatnonzero(lines[:, k] < lines[:, k + 1])
        bottom, top = lines[at, k], lines[at, k + 1]
        one, two = _spans_rows(r[at], (bottom + top) / 2), _spans_rows(s[at], (bottom + top) / 2)
        # a simple ring of n corners is crossed at most n times, an even number
        one, two = one[:, : one.shape[1] // 2 * 2], two[:, : two.shape[1] // 2 * 2]
        left, right = np.maximum(one[:, ::2, None], two[:, None, ::2]), np.minimum(one[:, 1::2, None], two[:, None, 1::2])
        wide = np.subtract(right, left, out=np.zeros(left.shape), where=np.isfinite(left))
        total[at] += np.maximum(wide, 0).sum(axis=(1, 2)) * (top - bottom)
    return total


def _iou_rows(r: np.ndarray, s: np.ndarray, least: float) -> np.ndarray:
    found, one, two = np.zeros(len(r)), _area_rows(r), _area_rows(s)
    some = (one > 0) & (two > 0)
    if least > 0:
        # two outlines share no more than their hulls do
        wide = np.minimum(r.max(axis=1), s.max(axis=1)) - np.maximum(r.min(axis=1), s.min(axis=1))
        some &= np.maximum(wide, 0).prod(axis=1) * (1 + 1e-6) >= least / (1 + least) * (one + two)
    at = np.flatnonzero(some)
    at = at[_simple_rows(r[at]) & _simple_rows(s[at])]
    both = np.minimum(np.minimum(_shared_rows(r[at], s[at]), one[at]), two[at])
    found[at] = both / (one[at] + two[at] - both)
    return found


def outline_ious(left: pa.Array, right: pa.Array, least: float = 0.0) -> np.ndarray:
    """outline_iou of two columns, row by row: pairs with as many corners a side are computed together as arrays. Pairs that cannot
    reach `least` may be given 0."""
    (p, p_at, n), (q, q_at, m) = _rings(left), _rings(right)
    out = np.zeros(len(left))
    order = np.lexsort((m, n))
    change = np.flatnonzero((np.diff(n[order]) != 0) | (np.diff(m[order]) != 0)) + 1
    for rows in np.split(order, change):
        if not len(rows) or n[rows[0]] < 3 or m[rows[0]] < 3:
            continue
        i, j = int(n[rows[0]]), int(m[rows[0]])
        step = max(1, CELLS // max(i * i, j * j, i * j))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            out[part] = _iou_rows(p[p_at[part, None] + np.arange(i)], q[q_at[part, None] + np.arange(j)], least)
    return out


def with_iou(pairs: DataFrame, left: str, right: str, out: str = "iou", least: float = 0.0) -> DataFrame:
    """pairs with the IoU of two columns of polygons; 0 where one is null. Pairs that cannot reach `least` may be given 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = outline_ious(batch.column(left), batch.column(right), least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, out])

    return pairs.mapInArrow(run, pairs.withColumn(out, F.lit(0.0)).schema)


def bounded(boxes: DataFrame, outline: str = "polygon") -> DataFrame:
    """boxes with the sides of their outlines' hulls as x1, y1, x2, y2."""
    at = lambda f, c: f(F.transform(outline, lambda q: q[c].cast("double")))
    return boxes.withColumns({"x1": at(F.array_min, "x"), "y1": at(F.array_min, "y"), "x2": at(F.array_max, "x"), "y2": at(F.array_max, "y")})


def _shoelace(p: Column) -> Column:
    """The area that a simple outline encloses; corners are taken from the first, as those far off would cost digits."""
    x, y = (lambda q: q["x"].cast("double") - p[0]["x"]), (lambda q: q["y"].cast("double") - p[0]["y"])
    after = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    turns = F.zip_with(p, after, lambda a, b: x(a) * y(b) - x(b) * y(a))
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, v: s + v)) / 2


def suppress_outlines(detections: DataFrame, iou: float, outline: str = "polygon") -> DataFrame:
    """Rows of detections (image_id, class_id, ord, score, a polygon) that are kept, by falling score then ord within image and class: a row goes if
    one kept before has a positive IoU of at least `iou` with it.

    Outlines are compared where their hulls share area, found by cells; the walk reads a row and then its clashes with earlier ones, and holds
    the kept places of one group.
    """
    n = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hulls = bounded(detections.select("image_id", "class_id", "ord", "score", F.col(outline).alias("polygon")))
    keep = ["ord", "score", "polygon"]
    sized = hulls.withColumn("size", _shoelace(F.col("polygon")))
    near = spatial.overlapping_pairs(sized, sized, ["image_id", "class_id"], (keep, keep), iou / (1 + iou) if iou > 0 else None)
    # by falling score, then place; rows without a score come last
    same = F.col("l.score").eqNullSafe(F.col("r.score")) & (F.col("l.ord") > F.col("r.ord"))
    later = F.coalesce(F.col("l.score") < F.col("r.score"), F.col("l.score").isNull() & F.col("r.score").isNotNull()) | same
    told = near.where(later).select("l.image_id", "l.class_id", F.col("l.score").alias("score"), F.col("l.ord").alias("ord"), F.col("r.ord").alias("before"), F.col("l.polygon").alias("p"), F.col("r.polygon").alias("q"))
    clashes = with_iou(told, "p", "q", least=iou).where((F.col("iou") > 0) & (F.col("iou") >= iou)).select("image_id", "class_id", "score", "ord", "before")
    rows = hulls.select("image_id", "class_id", "score", "ord", F.lit(None).cast("bigint").alias("before")).unionByName(clashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, current, free = None, set(), None, False
        out: list[tuple] = []
        for batch in batches:
            for image, cls, _, place, before in zip(*(c.to_pylist() for c in batch.columns)):
                if (image, cls) != group or place != current:
                    if current is not None and free:
                        kept.add(current)
                    elif current is not None:
                        out.append((*group, current))
                    if (image, cls) != group:
                        group, kept = (image, cls), set()
                    current, free = place, True
                elif before in kept:
                    free = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if current is not None and not free:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*group, current), kinds)], names=names)

    names = ["image_id", "class_id", "ord"]
    schema = hulls.select(*names).schema
    kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.int32() if f.dataType.simpleString() == "int" else pa.string() for f in schema]
    walked = rows.repartition(n, "image_id", "class_id").sortWithinPartitions("image_id", "class_id", F.desc("score"), "ord", F.asc_nulls_first("before"))
    return detections.join(walked.mapInArrow(run, schema), names, "left_anti")
