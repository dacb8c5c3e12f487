"""DataFrames of boxes from plain tuples."""

DET = "image_id bigint, class_id int, ord bigint, score double, x1 double, y1 double, x2 double, y2 double"
TRUTH = "image_id bigint, class_id int, ord bigint, x1 double, y1 double, x2 double, y2 double, difficult boolean"
UNIT = (0.0, 0.0, 10.0, 10.0)


def detections(spark, rows):
    """rows: (image, class, score, box)"""
    return spark.createDataFrame([(im, c, i, float(s), *map(float, b)) for i, (im, c, s, b) in enumerate(rows)], DET)


def truths(spark, rows):
    """rows: (image, class, box[, difficult])"""
    return spark.createDataFrame([(r[0], r[1], i, *map(float, r[2]), bool(r[3]) if len(r) > 3 else False) for i, r in enumerate(rows)], TRUTH)


def counts(report, scope, key):
    r = report.where(f"scope = '{scope}' and key = '{key}'").first()
    return (r["tp"], r["fp"], r["fn"])
