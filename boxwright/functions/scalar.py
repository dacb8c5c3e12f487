"""Rates, ranks, hashes, text and parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return rate(tp, tp + fn)


def false_discovery(tp: Column, fp: Column) -> Column:
    return rate(fp, tp + fp)


def precision(tp: Column, fp: Column) -> Column:
    return rate(tp, tp + fp)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return rate(2 * tp, 2 * tp + fp + fn)


def seeded_rank(seed: Column, value: Column) -> Column:
    """Hex digest of 'seed:value'. Hex order is the order of the digest's leading bytes as an unsigned number."""
    return F.sha2(F.concat(seed.cast("string"), F.lit(":"), value.cast("string")), 256)


def hashed_below(seed: Column, value: Column, most: Column) -> Column:
    """A reproducible number in 0 .. most - 1: the digest's first eight bytes, unsigned, modulo most."""
    head = F.conv(F.substring(seeded_rank(seed, value), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % most.cast("decimal(20,0)")).cast("bigint")


def source_group(stem: Column) -> Column:
    """The stem without a trailing _crop<number>; the stem itself if nothing would be left."""
    return F.coalesce(F.nullif(F.regexp_replace(stem, "(?i)_crop\\d+$", ""), F.lit("")), stem)


def threshold_grid(text: Column) -> Column:
    """Distinct ascending thresholds of a comma-separated list; anything outside 0 .. 1 raises."""
    parsed = F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("double"))
    bad = F.exists(parsed, lambda v: v.isNull() | (v < 0) | (v > 1) | F.isnan(v))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad threshold grid: "), text)).cast("array<double>")).otherwise(F.array_sort(F.array_distinct(parsed)))


def class_colour(class_id: Column) -> Column:
    part = lambda k: (F.lit(64) + class_id * k % 192).cast("int")
    return F.array(part(37), part(67), part(97))


def stable_float(value: Column, digits: int = 6) -> Column:
    return F.bround(value, digits)


def digest(value: Column) -> Column:
    """Digest of a value's canonical JSON (fields in schema order)."""
    return F.sha2(F.to_json(value), 256)


def phash_bits(coefficients: Column) -> Column:
    """A 64-character bit string of 64 coefficients: 1 where one is at least the median of all but the first."""
    rest = F.array_sort(F.slice(coefficients, 2, 63))
    median = F.element_at(rest, 32)
    return F.array_join(F.transform(coefficients, lambda v: F.when(v >= median, F.lit("1")).otherwise(F.lit("0"))), "")


def dct_low(pixels: Column, size: int = 32, keep: int = 8) -> Column:
    """The keep x keep lowest coefficients (row-major) of the two-dimensional DCT-II of a size x size array of luma.

    The matrix comes from its formula as two literals; the product is two folds, without user functions.
    """
    import math

    rows = [[math.sqrt((1 if k == 0 else 2) / size) * math.cos(math.pi * k * (2 * n + 1) / (2 * size)) for n in range(size)] for k in range(keep)]
    basis = F.array(*[F.array(*[F.lit(v) for v in row]) for row in rows])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    lines = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice(pixels, r * size + 1, size))
    across = F.transform(lines, lambda line: F.transform(basis, lambda b: dot(line, b)))
    columns = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda k: F.transform(across, lambda line: F.get(line, k)))
    return F.flatten(F.transform(basis, lambda b: F.transform(columns, lambda c: dot(c, b))))
