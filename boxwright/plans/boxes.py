"""Queries of filters, geometry, matching, suppression and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.functions import scalar as S
from boxwright.operators import filters, inference, matching, metrics, outlines, suppression
from boxwright.plans.registry import MATCHED, accept_sql, coarse_sql, iou_sql, query, spread, table, view
from boxwright.taxonomy import coarse_of, dimension

DET = "image_id, class_id, ord, score, x1, y1, x2, y2"


def thresholds(spark):
    """A threshold for all but every fifth class."""
    return spark.range(25).where("id % 5 <> 0").select(F.col("id").cast("int").alias("class_id"), (F.col("id") % 9 / F.lit(10.0)).alias("threshold"))


THR = "thr AS (SELECT CAST(range AS INT) AS class_id, range % 9 / 10.0::DOUBLE AS threshold FROM range(25) WHERE range % 5 <> 0)"


@query("PF1", f"WITH {THR} SELECT {DET} FROM det LEFT JOIN thr USING (class_id) WHERE score >= coalesce(threshold, 0)", ("det",))
def pf1(spark, d):
    return filters.over_class_threshold(view(spark, d, "det"), thresholds(spark))


@query("PF2", f"WITH {THR} SELECT {DET} FROM det JOIN thr USING (class_id) WHERE score >= threshold", ("det",))
def pf2(spark, d):
    return filters.pipeline_filter(view(spark, d, "det"), thresholds(spark))


@query("PF3", f"SELECT {DET} FROM det WHERE score >= 0.25::DOUBLE", ("det",))
def pf3(spark, d):
    return filters.at_threshold(view(spark, d, "det"), 0.25)


@query("PF4", f"SELECT {DET} FROM det WHERE score >= CASE WHEN class_id <= 3 THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END", ("det",))
def pf4(spark, d):
    return filters.at_ship_override(view(spark, d, "det"), 0.25, 0.4)


@query("PF5", f"SELECT {DET} FROM det WHERE NOT (class_id IN (3, 8, 24) AND score < 0.5::DOUBLE AND (x2 - x1) * (y2 - y1) < 500)", ("det",))
def pf5(spark, d):
    rules = spark.createDataFrame([(c, 0.5, 500.0) for c in (3, 8, 24)], "class_id int, min_score double, min_area double")
    return filters.drop_low_and_small(view(spark, d, "det"), rules)


@query("PF6", f"SELECT {DET} FROM det WHERE NOT (class_id = 24 AND score < 0.6::DOUBLE AND (x2 - x1) * (y2 - y1) < 520)", ("det",))
def pf6(spark, d):
    return filters.drop_low_and_small(view(spark, d, "det"), spark.createDataFrame([(24, 0.6, 520.0)], "class_id int, min_score double, min_area double"))


@query("PF7", f"SELECT {DET} FROM det WHERE class_id <= 3 AND score >= 0.3::DOUBLE", ("det",))
def pf7(spark, d):
    return suppression.select_coarse(view(spark, d, "det"), "ship", 0.3)


@query("PF8", f"SELECT {DET} FROM det WHERE image_id IN (SELECT image_id FROM img WHERE mode = 'L')", ("det", "img"))
def pf8(spark, d):
    return filters.for_images(view(spark, d, "det"), view(spark, d, "img").where("mode = 'L'"))


def _tiled(spark, d):
    det = view(spark, d, "det")
    return det.withColumns({"tile_x": (F.col("ord") % 3 * 60), "tile_y": (F.col("ord") % 2 * 50), "valid_width": F.lit(100), "valid_height": F.lit(100), "image_width": F.lit(220), "image_height": F.lit(150)})


TILED = "tl AS (SELECT *, ord % 3 * 60 AS tx, ord % 2 * 50 AS ty FROM det)"


@query("PF9", f"""WITH {TILED} SELECT ord FROM tl WHERE (x1 + x2) / 2 >= 0 AND (x1 + x2) / 2 < 100 AND (y1 + y2) / 2 >= 0 AND (y1 + y2) / 2 < 100
  AND NOT (tx > 0 AND x1 < 4) AND NOT (ty > 0 AND y1 < 4) AND NOT (tx + 100 < 220 AND x2 > 96) AND NOT (ty + 100 < 150 AND y2 > 96)""", ("det",))  # fmt: skip
def pf9(spark, d):
    return _tiled(spark, d).where(filters.inside_tile(4)).select("ord")


@query("PF10", f"WITH {TILED} SELECT ord, least(greatest(x1 + tx, 0), 220) AS x1, least(greatest(y1 + ty, 0), 150) AS y1, least(greatest(x2 + tx, 0), 220) AS x2, least(greatest(y2 + ty, 0), 150) AS y2 FROM tl", ("det",))
def pf10(spark, d):
    return filters.to_image(_tiled(spark, d)).select("ord", "x1", "y1", "x2", "y2")


@query("PF11", "SELECT ord, x2 <= 100 AND y2 <= 100 AS valid FROM det", ("det",))
def pf11(spark, d):
    return view(spark, d, "det").select("ord", filters.valid_annotation(G.polygon(G.box()), F.lit(100), F.lit(100)).alias("valid"))


@query("PF12", "SELECT ord, CASE WHEN class_id = 0 THEN 24 ELSE class_id END AS class_id FROM det", ("det",))
def pf12(spark, d):
    return filters.remap_classes(view(spark, d, "det"), {0: 24}).select("ord", "class_id")


@query("PF13", "SELECT stem, coalesce(nullif(regexp_replace(stem, '(?i)_crop[0-9]+$', ''), ''), stem) AS group_id FROM img", ("img",))
def pf13(spark, d):
    return view(spark, d, "img").select("stem", S.source_group(F.col("stem")).alias("group_id"))


@query("PF14", f"SELECT ord, {coarse_sql('class_id')} AS coarse FROM det", ("det",))
def pf14(spark, d):
    return view(spark, d, "det").join(F.broadcast(dimension(spark)), "class_id").select("ord", "coarse")


@query("G1", "SELECT ord, x1, y1, x2, y2 FROM det", ("det",))
def g1(spark, d):
    sides = G.obb_to_hbb(G.polygon(G.box()))
    return view(spark, d, "det").select("ord", *[c.alias(n) for c, n in zip(sides, G.BOX, strict=True)])


@query("G2", "SELECT ord, least(greatest(x1, 0), 79) AS x1, least(greatest(y1, 0), 69) AS y1, least(greatest(x2, 0), 79) AS x2, least(greatest(y2, 0), 69) AS y2 FROM det", ("det",))
def g2(spark, d):
    sides = G.obb_to_hbb(G.clip_polygon(G.polygon(G.box()), F.lit(80), F.lit(70)))
    return view(spark, d, "det").select("ord", *[c.alias(n) for c, n in zip(sides, G.BOX, strict=True)])


def _pairs(spark, d, touching: bool = True, keys: tuple[str, ...] = ("image_id",)):
    """Boxes of one image (and class): those that overlap, or all."""
    p, t = view(spark, d, "det"), view(spark, d, "truth")
    name = lambda df, x: df.select(*keys, F.col("ord").alias(f"{x}_ord"), *[F.col(c).alias(f"{x}_{c}") for c in G.BOX])
    return name(p, "p").join(name(t, "t"), list(keys)).where(G.intersects(G.box("p_"), G.box("t_")) if touching else F.lit(True))


PAIRS = "FROM det p JOIN truth t ON p.image_id = t.image_id"
TOUCH = "p.x1 < t.x2 AND t.x1 < p.x2 AND p.y1 < t.y2 AND t.y1 < p.y2"


@query("G3", f"SELECT p.ord AS p_ord, t.ord AS t_ord, {iou_sql('p', 't')} AS iou {PAIRS} AND {TOUCH}", ("det", "truth"))
def g3(spark, d):
    return _pairs(spark, d).select("p_ord", "t_ord", G.hbb_iou(G.box("p_"), G.box("t_")).alias("iou"))


@query("G4", f"SELECT p.ord AS p_ord, t.ord AS t_ord, round({iou_sql('p', 't')}, 6) AS iou {PAIRS} AND p.class_id = t.class_id AND {TOUCH}", ("det", "truth"))
def g4(spark, d):
    """Outlines of boxes of one class: the clipper must give what the box formula gives. Rotated outlines are tested by themselves."""
    return _pairs(spark, d, keys=("image_id", "class_id")).select("p_ord", "t_ord", F.round(G.polygon_iou(G.polygon(G.box("p_")), G.polygon(G.box("t_"))), 6).alias("iou"))


@query("G5", f"""SELECT p.ord AS p_ord, t.ord AS t_ord, {iou_sql('p', 't')} - (pow((p.x1 + p.x2) / 2 - (t.x1 + t.x2) / 2, 2) + pow((p.y1 + p.y2) / 2 - (t.y1 + t.y2) / 2, 2))
  / (pow(greatest(p.x2, t.x2) - least(p.x1, t.x1), 2) + pow(greatest(p.y2, t.y2) - least(p.y1, t.y1), 2)) AS diou {PAIRS}""", ("det", "truth"))  # fmt: skip
def g5(spark, d):
    return _pairs(spark, d, touching=False).select("p_ord", "t_ord", G.diou(G.box("p_"), G.box("t_")).alias("diou"))


@query("G6", """SELECT ord, CAST(least(greatest(round_even((x1 + x2 - 64) / 2, 0), 0), 56) AS INT) AS left_a, CAST(least(greatest(round_even((x1 + x2) / 2 - 32::DOUBLE, 0), 0), 56) AS INT) AS left_b FROM det""", ("det",))
def g6(spark, d):
    a = G.crop_origin_from_corners(F.col("x1"), F.col("x2"), F.lit(64), F.lit(120))
    b = G.crop_origin_from_centre((F.col("x1") + F.col("x2")) / 2, F.lit(64), F.lit(120))
    return view(spark, d, "det").select("ord", a.alias("left_a"), b.alias("left_b"))


@query("G7", "SELECT ord, CAST(least(greatest(round_even(greatest(x2 - x1, y2 - y1) * 2.5::DOUBLE, 0), 55), 62) AS INT) AS side FROM det", ("det",))
def g7(spark, d):
    return view(spark, d, "det").select("ord", G.crop_side(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 2.5, 55, 62).alias("side"))


@query("G8", f"SELECT p.ord AS p_ord, t.ord AS t_ord, p.x1 < t.x2 AND t.x1 < p.x2 AND p.y1 < t.y2 AND t.y1 < p.y2 AS touch {PAIRS}", ("det", "truth"))
def g8(spark, d):
    return _pairs(spark, d, touching=False).select("p_ord", "t_ord", G.intersects(G.box("p_"), G.box("t_")).alias("touch"))


@query("G9", """SELECT ord, ((greatest(x1, 20) - 20) + (least(x2, 90) - 20)) / 2 / 70 AS cx, ((greatest(y1, 10) - 10) + (least(y2, 80) - 10)) / 2 / 70 AS cy, ((least(x2, 90) - 20) - (greatest(x1, 20) - 20)) / 70 AS w,
  ((least(y2, 80) - 10) - (greatest(y1, 10) - 10)) / 70 AS h FROM det WHERE (x1 + x2) / 2 >= 20 AND (x1 + x2) / 2 < 90 AND (y1 + y2) / 2 >= 10 AND (y1 + y2) / 2 < 80""", ("det",))  # fmt: skip
def g9(spark, d):
    label = G.crop_label(G.box(), [F.lit(20.0), F.lit(10.0), F.lit(90.0), F.lit(80.0)])
    return view(spark, d, "det").select("ord", label.alias("l")).where("l is not null").select("ord", "l.*")


@query("G10", """SELECT image_id, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END AS fdr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (SELECT image_id, image_id % 4 AS tp, image_id % 3 AS fp, image_id % 5 % 4 AS fn FROM img)""", ("img",))  # fmt: skip
def g10(spark, d):
    tp, fp, fn = F.col("image_id") % 4, F.col("image_id") % 3, F.col("image_id") % 5 % 4
    return view(spark, d, "img").select("image_id", S.recall(tp, fn).alias("recall"), S.false_discovery(tp, fp).alias("fdr"), S.precision(tp, fp).alias("precision"), S.f1(tp, fp, fn).alias("f1"))


@query("G11", """WITH n AS (SELECT image_id, 64 + image_id * 7 AS length FROM img)
SELECT image_id, p AS position FROM (SELECT image_id, unnest(CASE WHEN length <= 64 THEN [0] ELSE list_distinct(list_append(range(0, CAST(length - 63 AS BIGINT), 48), CAST(length - 64 AS BIGINT))) END) AS p FROM n)""", ("img",))  # fmt: skip
def g11(spark, d):
    n = spread(view(spark, d, "img").select("image_id", (F.lit(64) + F.col("image_id") * 7).alias("length")), "image_id")
    return n.select("image_id", F.explode(G.axis_positions(F.col("length"), F.lit(64), F.lit(48))).alias("position"))


@query("G12", "SELECT stem, sha256('42:' || stem) AS rank FROM img", ("img",))
def g12(spark, d):
    return view(spark, d, "img").select("stem", S.seeded_rank(F.lit(42), F.col("stem")).alias("rank"))


@query("G13", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings), m AS (SELECT vec_id, c, list_sort(c[2:64])[32] AS median FROM v)
SELECT vec_id, array_to_string(list_transform(c, lambda x: CASE WHEN x >= median THEN '1' ELSE '0' END), '') AS bits FROM m""")  # fmt: skip
def g13(spark, d):
    c = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", S.phash_bits(c).alias("bits"))


@query("G14", "SELECT stem, CAST(CAST('0x' || substr(sha256('7:' || stem), 1, 16) AS UBIGINT) % 57 AS BIGINT) AS x FROM img", ("img",))
def g14(spark, d):
    return view(spark, d, "img").select("stem", S.hashed_below(F.lit(7), F.col("stem"), F.lit(57)).alias("x"))


@query("G15", """SELECT DISTINCT image_id, t FROM (SELECT image_id, unnest([0.5::DOUBLE, (image_id % 10) / 10.0::DOUBLE, 0.1::DOUBLE]) AS t FROM img)""", ("img",))
def g15(spark, d):
    text = F.concat(F.lit("0.5, "), (F.col("image_id") % 10 / F.lit(10.0)).cast("string"), F.lit(",0.1 "))
    return view(spark, d, "img").select("image_id", F.explode(S.threshold_grid(text)).alias("t"))


@query("G16", """SELECT stem, sha256('{"stem":"' || stem || '","width":' || width || '}') AS digest FROM img""", ("img",))
def g16(spark, d):
    return view(spark, d, "img").select("stem", S.digest(F.struct("stem", "width")).alias("digest"))


@query("G17", "SELECT DISTINCT class_id, CAST(64 + class_id * 37 % 192 AS INT) AS r, CAST(64 + class_id * 67 % 192 AS INT) AS g, CAST(64 + class_id * 97 % 192 AS INT) AS b FROM det", ("det",))
def g17(spark, d):
    c = S.class_colour(F.col("class_id"))
    return view(spark, d, "det").select("class_id").distinct().select("class_id", c[0].alias("r"), c[1].alias("g"), c[2].alias("b"))


@query("G18", "SELECT ord, round(score, 6) AS value FROM det", ("det",))
def g18(spark, d):
    return view(spark, d, "det").select("ord", S.stable_float(F.col("score")).alias("value"))


@query("J1", f"WITH {MATCHED} SELECT image_id, scope, key, p_ord, t_ord, iou, score FROM matched", ("det", "truth"))
def j1(spark, d):
    return matching.greedy_match(view(spark, d, "det"), view(spark, d, "truth"))


MODELS = """, two AS (SELECT 'a' AS model, * FROM det UNION ALL SELECT 'b', image_id, class_id, ord, score, x1 + ord % 7, y1, x2 + ord % 7, y2 FROM det),
e2 AS (SELECT p.model, p.image_id, c.coarse, p.ord AS p, t.ord AS t, p.score AS s, {iou} AS i FROM two p JOIN truth t ON p.image_id = t.image_id AND NOT t.difficult AND {cp} = {ct}, (SELECT 1) z, LATERAL (SELECT {cp} AS coarse) c
  WHERE {iou} >= CASE WHEN t.class_id = 24 THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END),
m2 AS (SELECT model, image_id, coarse, unnest({accept}) AS m FROM (SELECT model, image_id, coarse, list({{'p': p, 't': t}} ORDER BY s DESC, p, i DESC, t) AS l FROM e2 GROUP BY ALL))""".format(
    iou=iou_sql("p", "t"), cp=coarse_sql("p.class_id"), ct=coarse_sql("t.class_id"), accept=accept_sql("l", "k.p = x.p OR k.t = x.t")
)


def _models(spark, d):
    det = view(spark, d, "det")
    moved = det.withColumns({c: F.col(c) + F.col("ord") % 7 for c in ("x1", "x2")})
    return det.withColumn("model", F.lit("a")).unionByName(moved.withColumn("model", F.lit("b")))


@query("J2", "WITH one AS (SELECT 1)" + MODELS + " SELECT model, image_id, coarse, m.p AS p_ord, m.t AS t_ord FROM m2", ("det", "truth"))
def j2(spark, d):
    return matching.model_outcomes(_models(spark, d), view(spark, d, "truth")).select("model", "image_id", "coarse", "p_ord", "t_ord")


@query("J3", f"WITH {MATCHED} SELECT image_id, key AS coarse, p_ord, t_ord FROM matched WHERE scope = 'coarse'", ("det", "truth"))
def j3(spark, d):
    m = matching.greedy_match(view(spark, d, "det"), view(spark, d, "truth"), ("coarse",))
    return m.select("image_id", F.col("key").alias("coarse"), "p_ord", "t_ord")


FP = f"""{MATCHED}, fp AS (SELECT d.*, {coarse_sql('d.class_id')} AS coarse FROM det d WHERE ord NOT IN (SELECT p_ord FROM matched WHERE scope = 'coarse')),
fps AS (SELECT f.image_id, f.ord, f.coarse, CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE NOT t.difficult AND t.image_id = f.image_id AND {coarse_sql('t.class_id')} = f.coarse AND {iou_sql('f', 't')} > 0) THEN 'overlap' ELSE 'background' END AS source FROM fp f)"""


@query("J4", f"WITH {FP} SELECT image_id, ord, coarse, source FROM fps", ("det", "truth"))
def j4(spark, d):
    return matching.false_positive_sources(view(spark, d, "det"), view(spark, d, "truth")).select("image_id", "ord", "coarse", "source")


def _vehicles(df):
    return df.withColumn("class_id", F.lit(24))


def _j5_sql(main: str = "ord % 2 = 0", proposals: str = "ord % 2 = 1", name: str = "") -> str:
    """Tables up to lab{name}: the proposals with matched, label and reason."""

    def greedy(table: str, p: str, t: str) -> str:
        return f"""{table} AS (SELECT image_id, m.p AS p, m.t AS t FROM (SELECT image_id, unnest({accept_sql('l', 'k.p = x.p OR k.t = x.t')}) AS m FROM (SELECT p.image_id, list({{'p': p.ord, 't': t.ord}} ORDER BY p.score DESC, p.ord, {iou_sql('p', 't')} DESC, t.ord) AS l
  FROM {p} p JOIN {t} t ON p.image_id = t.image_id WHERE {iou_sql('p', 't')} >= 0.35::DOUBLE GROUP BY p.image_id)))"""

    return f"""mn{name} AS (SELECT * FROM det WHERE {main}), pr{name} AS (SELECT * FROM det WHERE {proposals}), tr{name} AS (SELECT * FROM truth WHERE NOT difficult),
{greedy('bm' + name, 'mn' + name, 'tr' + name)}, fr{name} AS (SELECT * FROM tr{name} WHERE ord NOT IN (SELECT t FROM bm{name})),
rs{name} AS (SELECT p.* FROM pr{name} p WHERE NOT EXISTS (SELECT 1 FROM mn{name} c WHERE c.image_id = p.image_id AND {iou_sql('p', 'c')} >= 0.35::DOUBLE)), {greedy('wn' + name, 'rs' + name, 'fr' + name)},
cl{name} AS (SELECT * FROM tr{name} WHERE ord IN (SELECT t FROM bm{name} UNION ALL SELECT t FROM wn{name})), hd{name} AS (SELECT q.ord, min(c.ord) AS held FROM rs{name} q JOIN cl{name} c ON c.image_id = q.image_id AND {iou_sql('q', 'c')} >= 0.35::DOUBLE GROUP BY q.ord),
lab{name} AS (SELECT q.*, coalesce(wn{name}.t, held) AS matched, CAST(wn{name}.t IS NOT NULL AS INT) AS label, CASE WHEN q.ord NOT IN (SELECT ord FROM rs{name}) THEN 'duplicate_main' WHEN wn{name}.t IS NOT NULL THEN 'recoverable_truth' WHEN held IS NOT NULL THEN 'duplicate_proposal' ELSE 'background' END AS reason
FROM pr{name} q LEFT JOIN wn{name} ON q.ord = wn{name}.p LEFT JOIN hd{name} ON hd{name}.ord = q.ord)"""


@query("J5", f"WITH {_j5_sql()} SELECT image_id, ord, matched, label, reason FROM lab", ("det", "truth"))
def j5(spark, d):
    det, t = _vehicles(view(spark, d, "det")), _vehicles(view(spark, d, "truth"))
    return matching.label_proposals(det.where("ord % 2 = 0"), det.where("ord % 2 = 1"), t).select("image_id", "ord", "matched", "label", "reason")


@query("J6", f"""WITH {_j5_sql("ord % 3 = 0", "ord % 3 = 1")}, {_j5_sql("ord % 3 = 0", "ord % 3 = 2", "2")}, l AS (SELECT * FROM lab WHERE reason <> 'duplicate_main'), r AS (SELECT * FROM lab2 WHERE reason <> 'duplicate_main'),
ff AS (SELECT image_id, m.p AS l_ord, m.t AS r_ord FROM (SELECT image_id, unnest({accept_sql('l', 'k.p = x.p OR k.t = x.t')}) AS m FROM (SELECT l.image_id, list({{'p': l.ord, 't': r.ord}} ORDER BY l.score DESC, l.ord, r.score DESC, r.ord) AS l
FROM l JOIN r ON l.image_id = r.image_id WHERE {iou_sql('l', 'r')} >= 0.35::DOUBLE GROUP BY l.image_id)))
SELECT ff.image_id, l_ord, r_ord, label FROM ff JOIN lab ON lab.ord = l_ord""", ("det", "truth"))  # fmt: skip
def j6(spark, d):
    det, t = _vehicles(view(spark, d, "det")), _vehicles(view(spark, d, "truth"))
    return matching.consensus(*(det.where(f"ord % 3 = {i}") for i in range(3)), t)


@query("J7", f"SELECT p.ord FROM det p WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE p.image_id = t.image_id AND {iou_sql('p', 't')} >= 0.83::DOUBLE)", ("det", "truth"))
def j7(spark, d):
    return matching.overlapping(view(spark, d, "det"), view(spark, d, "truth"), 0.83, ["image_id"], "left_anti").select("ord")


@query("J8", f"SELECT p.ord, (SELECT min(t.ord) FROM truth t WHERE p.image_id = t.image_id AND {iou_sql('p', 't')} >= 0.2::DOUBLE) AS t_ord FROM det p", ("det", "truth"))
def j8(spark, d):
    return matching.first_overlapping_truth(view(spark, d, "det"), view(spark, d, "truth"), 0.2).select("ord", "t_ord")


AP_EDGES = f"""e AS (SELECT p.image_id, p.class_id, p.ord AS p_ord, t.ord AS t_ord, p.score, {iou_sql('p', 't')} AS iou FROM det p JOIN (SELECT * FROM truth WHERE NOT difficult) t ON p.image_id = t.image_id AND p.class_id = t.class_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, p_ord ORDER BY iou DESC, t_ord) AS r FROM e WHERE iou >= 0.1::DOUBLE) WHERE r = 1),
w AS (SELECT b.*, threshold FROM b, (SELECT unnest([0.1::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS threshold) WHERE iou >= threshold),
ap AS (SELECT image_id, class_id, p_ord, t_ord, threshold, iou FROM (SELECT *, row_number() OVER (PARTITION BY image_id, t_ord, threshold ORDER BY score DESC, p_ord) AS q FROM w) WHERE q = 1)"""


@query("J9", f"WITH {AP_EDGES} SELECT * FROM ap", ("det", "truth"))
def j9(spark, d):
    return matching.ap_match(view(spark, d, "det"), view(spark, d, "truth").where("not difficult"), [0.1, 0.3, 0.5])


#: Hashes of 64 bits that differ in a few bits within a family.
HASHES = """h AS (SELECT doc_id AS k, 'g' || CAST(doc_id % 97 AS VARCHAR) AS g, md5(CAST(floor(doc_id / 3) AS BIGINT)::VARCHAR)[1:14] || CASE doc_id % 3 WHEN 0 THEN '00' WHEN 1 THEN '0f' ELSE 'ff' END AS b FROM documents)"""


def _hashes(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, "00").when(F.col("doc_id") % 3 == 1, "0f").otherwise("ff")
    base = F.substring(F.md5(F.floor(F.col("doc_id") / 3).cast("bigint").cast("string").cast("binary")), 1, 14)
    return table(spark, d, "documents").select(F.col("doc_id").alias("stem"), F.concat(F.lit("g"), (F.col("doc_id") % 97).cast("string")).alias("group_id"), F.concat(base, tail).alias("phash"))


@query("J10", f"""WITH {HASHES} SELECT a.k AS left, b.k AS right, CAST(bit_count(xor(('0x' || a.b)::UBIGINT, ('0x' || b.b)::UBIGINT)) AS INT) AS distance FROM h a JOIN h b ON a.k < b.k AND a.g <> b.g
WHERE bit_count(xor(('0x' || a.b)::UBIGINT, ('0x' || b.b)::UBIGINT)) <= 6""")  # fmt: skip
def j10(spark, d):
    return matching.hamming_pairs(_hashes(spark, d))


@query("J11", "SELECT ord, stem, group_id FROM det JOIN img USING (image_id)", ("det", "img"))
def j11(spark, d):
    return matching.complete_join(view(spark, d, "det"), view(spark, d, "img"), "image_id").select("ord", "stem", "group_id")


@query("J13", "SELECT doc_id, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'paired' WHEN d.doc_id IS NOT NULL THEN 'left only' ELSE 'right only' END AS state FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def j13(spark, d):
    return matching.paired(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


NMS = "SELECT image_id, class_id, m.ord AS ord, m.score AS score, m.x1 AS x1, m.y1 AS y1, m.x2 AS x2, m.y2 AS y2 FROM (SELECT image_id, class_id, unnest({fold}) AS m FROM ({lists}))"
STRUCT = "{'score': score, 'ord': ord, 'class_id': class_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"


def nms_sql(source: str, clash: str) -> str:
    return NMS.format(fold=accept_sql("l", clash), lists=f"SELECT image_id, class_id, list({STRUCT} ORDER BY score DESC, ord) AS l FROM {source} GROUP BY ALL")


@query("N1", nms_sql("nmsbox", f"{iou_sql('k', 'x')} > 0 AND {iou_sql('k', 'x')} >= 0.3::DOUBLE"), ("nmsbox",))
def n1(spark, d):
    return suppression.merge_detections(view(spark, d, "nmsbox"), 0.3)


@query("N1_polygons", nms_sql("nmsbox", f"{iou_sql('k', 'x')} > 0 AND {iou_sql('k', 'x')} >= 0.3037::DOUBLE"), ("nmsbox",))
def n1_polygons(spark, d):
    return suppression.merge_detections(view(spark, d, "nmsbox").where("true"), 0.3037, polygons=True)


#: Outlines around each box, by kind: a diamond, a notched arrow, a bow tie, a horseshoe; each with its IoU with the box and, last, that of two diamonds a quarter apart.
OUTLINE_SQL = "CASE ord % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.375 WHEN 2 THEN 0 WHEN 3 THEN 0.75 ELSE round(9.0::DOUBLE / 23, 9) END"


def _shape(*corners: tuple[float, float]):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return F.array(*[F.struct((F.col("x1") + w * u).alias("x"), (F.col("y1") + h * v).alias("y")) for u, v in corners])


@query("G4_outlines", f"SELECT ord, CAST({OUTLINE_SQL} AS DOUBLE) AS iou FROM det", ("det",))
def g4_outlines(spark, d):
    diamond, moved = [(0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)], [(0.75, 0), (1.25, 0.5), (0.75, 1), (0.25, 0.5)]
    shapes = [diamond, [(0, 0), (0.5, 0.25), (1, 0), (0.5, 1)], [(0, 0), (1, 1), (0, 1), (1, 0)], [(0, 0), (0.25, 0), (0.25, 0.5), (0.75, 0.5), (0.75, 0), (1, 0), (1, 1), (0, 1)], diamond]
    kind = F.col("ord") % 5
    pick = F.when(kind == 0, _shape(*shapes[0]))
    for k in range(1, 5):
        pick = pick.when(kind == k, _shape(*shapes[k]))
    other = F.when(kind == 4, _shape(*moved)).otherwise(_shape((0, 0), (1, 0), (1, 1), (0, 1)))
    found = outlines.with_iou(spread(view(spark, d, "det"), "ord").select("ord", pick.alias("p"), other.alias("q")), "p", "q")
    return found.select("ord", F.round("iou", 9).alias("iou"))


#: An L is two boxes that share no area: its upper left quarter beside the left half, so SQL can tell what two of them share.
ELLS = """l AS (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM nmsbox), ls AS (SELECT image_id, class_id, ord, score, x1, y1, x2, y2, 3 * (x2 - x1) * (y2 - y1) / 4 AS size,
[{'a': x1, 'b': y1, 'c': mx, 'd': y2}, {'a': mx, 'b': my, 'c': x2, 'd': y2}] AS parts FROM l)"""
ELL_SHARED = "list_sum(list_transform(k.parts, lambda p: list_sum(list_transform(x.parts, lambda q: greatest(0, least(p.c, q.c) - greatest(p.a, q.a)) * greatest(0, least(p.d, q.d) - greatest(p.b, q.b))))))"


@query("N1_outlines", f"""WITH RECURSIVE {ELLS}, e AS (SELECT x.ord AS later, k.ord AS sooner FROM ls x JOIN ls k ON k.image_id = x.image_id AND k.class_id = x.class_id AND (k.score > x.score OR (k.score = x.score AND k.ord < x.ord))
WHERE {ELL_SHARED} / (k.size + x.size - {ELL_SHARED}) >= 0.3037::DOUBLE),
r AS (SELECT ord, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, ord) AS n, image_id, class_id FROM ls),
g AS (SELECT image_id, class_id, list({{'o': ord, 'b': b}} ORDER BY n) AS l FROM r LEFT JOIN (SELECT later, list(sooner) AS b FROM e GROUP BY later) ON later = ord GROUP BY ALL),
w AS (SELECT image_id, class_id, 0 AS i, []::BIGINT[] AS kept, l FROM g UNION ALL SELECT image_id, class_id, i + 1, CASE WHEN list_has_any(coalesce(l[i + 1].b, []::BIGINT[]), kept) THEN kept ELSE list_append(kept, l[i + 1].o) END, l FROM w WHERE i < len(l))
SELECT image_id, class_id, unnest(kept) AS ord FROM w WHERE i = len(l)""", ("nmsbox",))  # fmt: skip
def n1_outlines(spark, d):
    ell = _shape((0, 0), (0.5, 0), (0.5, 0.5), (1, 0.5), (1, 1), (0, 1))
    return outlines.suppress_outlines(view(spark, d, "nmsbox").withColumn("polygon", ell), 0.3037).select("image_id", "class_id", "ord")


@query("N2", nms_sql("(SELECT * FROM nmsbox WHERE class_id <> 24)", f"{iou_sql('k', 'x')} >= CASE WHEN x.class_id = 0 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END") + f" UNION ALL SELECT image_id, class_id, ord, score, x1, y1, x2, y2 FROM nmsbox WHERE class_id = 24", ("nmsbox",))
def n2(spark, d):
    rules = spark.createDataFrame([(0, "iou", 0.2), (12, "iou", 0.4)], "class_id int, method string, threshold double")
    return suppression.suppress_classes(view(spark, d, "nmsbox"), rules)


CENTRES = "(pow((k.x1 + k.x2) / 2 - (x.x1 + x.x2) / 2, 2) + pow((k.y1 + k.y2) / 2 - (x.y1 + x.y2) / 2, 2)) / (pow(greatest(k.x2, x.x2) - least(k.x1, x.x1), 2) + pow(greatest(k.y2, x.y2) - least(k.y1, x.y1), 2))"


@query("N2_diou", nms_sql("nmsbox", f"CASE WHEN x.class_id = 24 THEN true ELSE {iou_sql('k', 'x')} - {CENTRES} >= CASE WHEN x.class_id = 0 THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END END"), ("nmsbox",))
def n2_diou(spark, d):
    rules = spark.createDataFrame([(0, "diou", 0.15), (12, "diou", 0.3), (24, "iou", 0.0)], "class_id int, method string, threshold double")
    return suppression.suppress_classes(view(spark, d, "nmsbox"), rules)


def supplement_sql(primary: str, supplement: str, iou: str) -> str:
    """Primary rows and free supplements, per image (one coarse class)."""
    both = f"SELECT *, 0 AS rank FROM ({primary}) UNION ALL SELECT *, 1 FROM ({supplement})"
    lists = f"SELECT image_id, list({{'rank': rank, 'score': score, 'ord': ord, 'class_id': class_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY rank, score DESC, ord) AS l FROM ({both}) GROUP BY image_id"
    clash = f"x.rank = 1 AND {iou_sql('k', 'x')} >= {iou}"
    return f"SELECT image_id, m.class_id AS class_id, m.ord AS ord, m.score AS score, m.x1 AS x1, m.y1 AS y1, m.x2 AS x2, m.y2 AS y2 FROM (SELECT image_id, unnest({accept_sql('l', clash)}) AS m FROM ({lists}))"


def _n(src: str, cond: str) -> str:
    return f"SELECT {DET} FROM nmsbox WHERE {src} AND {cond}"


@query("N3", f"""{_n('ord % 3 = 0', 'class_id = 0 AND score >= 0.1::DOUBLE')} UNION ALL {_n('ord % 3 = 1', 'class_id = 12 AND score >= 0.2::DOUBLE')}
UNION ALL {supplement_sql(_n('ord % 3 = 0', 'class_id = 24 AND score >= 0.3::DOUBLE'), _n('ord % 3 = 2', 'class_id = 24 AND score >= 0.4::DOUBLE'), '0.1::DOUBLE')}""", ("nmsbox",))  # fmt: skip
def n3(spark, d):
    b = view(spark, d, "nmsbox")
    sources = {"a": b.where("ord % 3 = 0"), "b": b.where("ord % 3 = 1"), "c": b.where("ord % 3 = 2")}
    return suppression.fuse_ranking(sources, {"ship": ("a", 0.1), "aircraft": ("b", 0.2), "vehicle": ("a", 0.3)}, ("c", 0.4), 0.1)


@query("N4", f"""{supplement_sql(_n('ord % 3 = 0', 'class_id = 12 AND score >= 0.2::DOUBLE'), _n('ord % 3 = 1', 'class_id = 12 AND score >= 0.5::DOUBLE'), '0.15::DOUBLE')} UNION ALL
{supplement_sql(_n('ord % 3 = 2', 'class_id = 0 AND score >= 0.1::DOUBLE'), _n('ord % 3 = 0', 'class_id = 0 AND score >= 0.6::DOUBLE'), '0.25::DOUBLE')} UNION ALL
{_n('ord % 3 = 2', 'class_id = 24 AND score >= 0.3::DOUBLE AND NOT (score < 0.5::DOUBLE AND (x2 - x1) * (y2 - y1) < 1500)')}""", ("nmsbox",))  # fmt: skip
def n4(spark, d):
    b = view(spark, d, "nmsbox")
    t = spark.createDataFrame([(0, 0.1), (12, 0.2), (24, 0.3)], "class_id int, threshold double")
    return suppression.fuse_multiscale(b.where("ord % 3 = 0"), b.where("ord % 3 = 1"), b.where("ord % 3 = 2"), t, (0.5, 0.15), (0.6, 0.25), 0.5, 1500.0)


@query("N5", supplement_sql(_n("ord % 2 = 0", "class_id = 0"), _n("ord % 2 = 1", "class_id = 0"), "0.25::DOUBLE"), ("nmsbox",))
def n5(spark, d):
    b = view(spark, d, "nmsbox").where("class_id = 0")
    return suppression.add_supplements(b.where("ord % 2 = 0"), b.where("ord % 2 = 1"), 0.25)


RATES = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN fp / (tp + fp) ELSE 0 END AS fdr"
EVAL = f"""{MATCHED},
np AS (SELECT image_id, scope, key, count(*) AS n FROM pk GROUP BY ALL), nt AS (SELECT image_id, scope, key, count(*) AS n FROM tk GROUP BY ALL), nm AS (SELECT image_id, scope, key, count(*) AS n FROM matched GROUP BY ALL),
fl AS (SELECT image_id, scope, key, CAST(sum(m) AS BIGINT) AS tp, CAST(sum(p) - sum(m) AS BIGINT) AS fp, CAST(sum(t) - sum(m) AS BIGINT) AS fn FROM (SELECT image_id, scope, key, n AS p, 0 AS t, 0 AS m FROM np UNION ALL SELECT image_id, scope, key, 0, n, 0 FROM nt UNION ALL SELECT image_id, scope, key, 0, 0, n FROM nm) GROUP BY ALL),
ks AS (SELECT 'overall' AS scope, 'all' AS key UNION ALL SELECT 'coarse', unnest(['ship', 'aircraft', 'vehicle']) UNION ALL SELECT 'fine', CAST(range AS VARCHAR) FROM range(25)),
sm AS (SELECT CASE WHEN scope = 'all' THEN 'overall' ELSE scope END AS scope, key, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM fl GROUP BY ALL),
im AS (SELECT 'image' AS scope, CAST(image_id AS VARCHAR) AS key, tp, fp, fn FROM fl WHERE scope = 'all'),
al AS (SELECT scope, key, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn FROM ks LEFT JOIN sm USING (scope, key) UNION ALL SELECT * FROM im),
report AS (SELECT *, {RATES} FROM al)"""


@query("A1", f"WITH {EVAL} SELECT * FROM report", ("det", "truth"))
def a1(spark, d):
    return metrics.evaluate(view(spark, d, "det"), view(spark, d, "truth"))


@query("A2", f"""WITH {FP} SELECT coarse, count(*) FILTER (source = 'overlap') AS overlap, count(*) FILTER (source = 'background') AS background, count(*) AS total FROM fps GROUP BY coarse""", ("det", "truth"))
def a2(spark, d):
    return metrics.false_positive_audit(view(spark, d, "det"), view(spark, d, "truth"))


@query("A3", f"SELECT 'coarse' AS scope, {coarse_sql('class_id')} AS key, count(*) AS n FROM det GROUP BY ALL UNION ALL SELECT 'fine', CAST(class_id AS VARCHAR), count(*) FROM det GROUP BY ALL", ("det",))
def a3(spark, d):
    return metrics.class_counts(view(spark, d, "det"))


@query("A4", """SELECT 'targets' AS statistic, CAST(class_id AS VARCHAR) AS key, count(*) AS n FROM truth GROUP BY ALL UNION ALL SELECT 'images', CAST(class_id AS VARCHAR), count(DISTINCT image_id) FROM truth GROUP BY ALL
UNION ALL SELECT 'size', width || 'x' || height, count(*) FROM img GROUP BY ALL UNION ALL SELECT 'mode', mode, count(*) FROM img GROUP BY ALL UNION ALL SELECT 'groups', 'all', count(DISTINCT group_id) FROM img""", ("truth", "img"))  # fmt: skip
def a4(spark, d):
    return metrics.audit_statistics(view(spark, d, "img"), view(spark, d, "truth"))


@query("A5", f"SELECT CASE WHEN image_id % 6 = 0 THEN 'val' ELSE 'train' END AS split, {coarse_sql('class_id')} AS coarse, class_id, count(*) AS n FROM truth GROUP BY ALL", ("truth",))
def a5(spark, d):
    return metrics.split_counts(view(spark, d, "truth").withColumn("split", F.when(F.col("image_id") % 6 == 0, "val").otherwise("train")))


@query("A6", "SELECT event_type, count(value) AS n, median(value) AS median, quantile_cont(value, 0.95::DOUBLE) AS p95, max(value) AS max FROM events GROUP BY event_type")
def a6(spark, d):
    return metrics.durations(table(spark, d, "events"), "value", "event_type")


@query("A8", "SELECT event_type, count(value) AS n, median(value) AS median, quantile_cont(value, 0.95::DOUBLE) AS p95, max(value) AS max, bool_and(value <= 20.0::DOUBLE - 1.0::DOUBLE) AS passed FROM events GROUP BY event_type")
def a8(spark, d):
    return metrics.latency_gate(table(spark, d, "events"), "value", 20.0, 1.0, "event_type")


@query("A9", "WITH one AS (SELECT 1)" + MODELS + f""", f AS (SELECT coarse, image_id, m.t AS t, bool_or(model = 'a') AS a, bool_or(model = 'b') AS b FROM m2 GROUP BY ALL),
n AS (SELECT coarse, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (b AND NOT a) AS right_only, count(*) AS either FROM f GROUP BY coarse),
tt AS (SELECT {coarse_sql('class_id')} AS coarse, count(*) AS truths FROM truth WHERE NOT difficult GROUP BY ALL)
SELECT coarse, coalesce(shared, 0) AS shared, coalesce(left_only, 0) AS left_only, coalesce(right_only, 0) AS right_only, coalesce(either, 0) AS either, truths, coalesce(either, 0) / truths AS oracle_recall FROM tt LEFT JOIN n USING (coarse)""", ("det", "truth"))  # fmt: skip
def a9(spark, d):
    return metrics.complementarity(_models(spark, d), view(spark, d, "truth"), "a", "b").select("coarse", "shared", "left_only", "right_only", "either", "truths", "oracle_recall")


LEVELS = ", ".join(f"{v!r}::DOUBLE" for v in metrics.AP_THRESHOLDS)


@query("A10", f"""WITH t AS (SELECT * FROM truth WHERE NOT difficult QUALIFY row_number() OVER (PARTITION BY image_id, class_id, x1, y1, x2, y2 ORDER BY ord) = 1),
p AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) <= 300), th AS (SELECT unnest([{LEVELS}]) AS threshold), nt AS (SELECT class_id, count(*) AS truths FROM t GROUP BY 1),
e AS (SELECT p.image_id, p.class_id, p.ord AS p_ord, t.ord AS t_ord, p.score, {iou_sql('p', 't')} AS iou FROM p JOIN t ON p.image_id = t.image_id AND p.class_id = t.class_id WHERE {iou_sql('p', 't')} >= 0.5::DOUBLE),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY p_ord ORDER BY iou DESC, t_ord) = 1),
h AS (SELECT p_ord, threshold FROM b, th WHERE iou >= threshold QUALIFY row_number() OVER (PARTITION BY t_ord, threshold ORDER BY score DESC, p_ord) = 1),
m AS (SELECT p.class_id, p.image_id, p.ord, p.score, th.threshold, h.p_ord IS NOT NULL AS hit FROM p CROSS JOIN th LEFT JOIN h ON h.p_ord = p.ord AND h.threshold = th.threshold),
r AS (SELECT class_id, threshold, hit, count(*) OVER o AS k, count(*) FILTER (hit) OVER o AS tp FROM m WINDOW o AS (PARTITION BY class_id, threshold ORDER BY score DESC, image_id, ord ROWS UNBOUNDED PRECEDING)),
c AS (SELECT class_id, threshold, tp / truths AS r, tp / k AS p FROM r JOIN nt USING (class_id) WHERE hit),
g AS (SELECT CAST(range AS INT) AS g, CASE WHEN range = 100 THEN 1.0::DOUBLE ELSE range * 0.01::DOUBLE END AS x FROM range(101)),
y AS (SELECT nt.class_id, th.threshold, g, coalesce(max(p), 0) AS y FROM nt CROSS JOIN th CROSS JOIN g LEFT JOIN c ON c.class_id = nt.class_id AND c.threshold = th.threshold AND c.r > g.x GROUP BY nt.class_id, th.threshold, g)
SELECT nt.class_id, threshold, truths, round(sum(CASE WHEN g IN (0, 100) THEN y / 2 ELSE y END) * 0.01, 8) AS ap FROM nt JOIN y USING (class_id) GROUP BY ALL""", ("det", "truth"))  # fmt: skip
def a10(spark, d):
    return metrics.average_precision(view(spark, d, "det"), view(spark, d, "truth")).withColumn("ap", F.round("ap", 8))


@query("A10_classes")
def a10_classes(spark, d):
    """Precision, recall, F1 and both averages of each class, and their means (class_id null)."""
    per = metrics.detection_metrics(view(spark, d, "det"), view(spark, d, "truth"))
    mean = metrics.mean_detection_metrics(per)
    return per.unionByName(mean.select(F.lit(None).cast("int").alias("class_id"), F.lit(None).cast("bigint").alias("truths"), "precision", "recall", F.lit(None).cast("double").alias("f1"), F.col("map50").alias("ap50"), F.col("map50_95").alias("ap50_95")))


@query("A10_mean")
def a10_mean(spark, d):
    return metrics.mean_average_precision(metrics.average_precision(view(spark, d, "det"), view(spark, d, "truth")))


@query("A11", """WITH r AS (SELECT lang, l.quality AS y, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, d.doc_id) AS k, sum(l.quality) OVER (PARTITION BY lang ORDER BY n_chars DESC, d.doc_id ROWS UNBOUNDED PRECEDING) AS tp FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, round(coalesce(avg(CASE WHEN y = 1 THEN tp / k END), 0), 9) AS ap FROM r GROUP BY lang""")  # fmt: skip
def a11(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return metrics.binary_average_precision(j, "n_chars", "quality", "doc_id", "lang").select("lang", F.round("ap", 9).alias("ap"))


@query("A12", "SELECT doc_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY quality) AS weight FROM labels")
def a12(spark, d):
    return metrics.sampler_weights(table(spark, d, "labels"), "quality").select("doc_id", F.col("weight").cast("double").alias("weight"))


@query("A13", f"""WITH b AS (SELECT group_id, class_id, {coarse_sql('class_id')} AS coarse FROM truth JOIN img USING (image_id)), c AS (SELECT group_id, count(*) AS boxes, count(*) FILTER (coarse = 'aircraft') AS aircraft_boxes, count(*) FILTER (coarse = 'ship') AS ship_boxes, count(*) FILTER (coarse = 'vehicle') AS vehicle_boxes, count(DISTINCT class_id) AS classes FROM b GROUP BY group_id)
SELECT group_id, images, coalesce(boxes, 0) AS boxes, coalesce(aircraft_boxes, 0) AS aircraft_boxes, coalesce(ship_boxes, 0) AS ship_boxes, coalesce(vehicle_boxes, 0) AS vehicle_boxes, coalesce(classes, 0) AS classes FROM (SELECT group_id, count(*) AS images FROM img GROUP BY group_id) LEFT JOIN c USING (group_id)""", ("truth", "img"))  # fmt: skip
def a13(spark, d):
    return metrics.group_statistics(view(spark, d, "img"), view(spark, d, "truth"))


@query("A14", f"SELECT {coarse_sql('class_id')} AS coarse, count(*) AS original, CAST(sum(image_id % 3) AS BIGINT) AS duplicated, CAST(sum(1 + image_id % 3) AS BIGINT) AS balanced FROM truth GROUP BY ALL", ("truth",))
def a14(spark, d):
    return metrics.resample_accounting(view(spark, d, "truth"), view(spark, d, "img").select("image_id", (1 + F.col("image_id") % 3).alias("factor")))


@query("A15", "SELECT image_id, (CASE WHEN image_id % 4 + image_id % 3 > 0 THEN (image_id % 3) / (image_id % 4 + image_id % 3) ELSE 0 END) <= 0.4::DOUBLE AS feasible FROM img", ("img",))
def a15(spark, d):
    return view(spark, d, "img").select("image_id", metrics.vehicle_fdr_feasible(F.col("image_id") % 4, F.col("image_id") % 3, 0.4).alias("feasible"))


@query("A16", """WITH p AS (SELECT score, CAST(ord % 3 = 0 AS INT) AS label FROM det), n AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS added_tp, count(*) FILTER (score >= threshold AND label = 0) AS added_fp FROM p, (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS threshold) GROUP BY threshold)
SELECT *, (added_tp + 100) / 9000 AS recall, (added_fp + 10) / (added_tp + 100 + added_fp + 10) AS fdr, (added_fp + 10) / (added_tp + 100 + added_fp + 10) <= 0.6::DOUBLE AS feasible FROM n""", ("det",))  # fmt: skip
def a16(spark, d):
    p = view(spark, d, "det").select("score", (F.col("ord") % 3 == 0).cast("int").alias("label"))
    return metrics.operating_curve(p, [0.2, 0.5, 0.9], 100, 10, 9000, 0.6)


@query("W9", f"""WITH {MATCHED}, a AS (SELECT d.score, m.p_ord IS NOT NULL AS hit FROM det d LEFT JOIN (SELECT * FROM matched WHERE scope = 'all') m ON d.ord = m.p_ord), th AS (SELECT * FROM (VALUES (0, 0.9::DOUBLE), (1, 0.5::DOUBLE), (2, 1.0::DOUBLE)) v(place, threshold)),
n AS (SELECT place, threshold, count(*) FILTER (score >= threshold AND hit) AS tp, count(*) FILTER (score >= threshold AND NOT hit) AS fp FROM a, th GROUP BY ALL), f AS (SELECT *, (SELECT count(*) FROM truth WHERE NOT difficult) - tp AS fn FROM n)
SELECT CAST(place AS INT) AS place, threshold, tp, fp, fn, {RATES} FROM f""", ("det", "truth"))  # fmt: skip
def w9(spark, d):
    return metrics.sweep(view(spark, d, "det"), view(spark, d, "truth"), [0.9, 0.5, 1.0])


@query("TG1", """WITH t AS (SELECT image_id, width, height, unnest(CASE WHEN height <= 64 THEN [0] ELSE list_distinct(list_append(range(0, CAST(height - 63 AS BIGINT), 48), CAST(height - 64 AS BIGINT))) END) AS y FROM img),
u AS (SELECT *, unnest(CASE WHEN width <= 64 THEN [0] ELSE list_distinct(list_append(range(0, CAST(width - 63 AS BIGINT), 48), CAST(width - 64 AS BIGINT))) END) AS x FROM t)
SELECT image_id, image_id || '__x' || x || '_y' || y || '_s64' AS tile_id, x, y FROM u""", ("img",))  # fmt: skip
def tg1(spark, d):
    return inference.tiles(view(spark, d, "img"), 64, 0.25).select("image_id", "tile_id", "x", "y")


@query("TG3", "SELECT CAST(x.range AS INT) AS x, CAST(y.range AS INT) AS y, CAST(least(32 + (x.range + y.range) % 16, 1000) AS INT) AS w, CAST(least(32 + (x.range + y.range) % 16, 700) AS INT) AS h, CAST((x.range * 7 + y.range * 13) % 256 AS INT) AS grey FROM range(0, 1000, 64) x, range(0, 700, 64) y")
def tg3(spark, d):
    return inference.synthetic_rectangles(spark, 1000, 700, 64)


def demo_detector(tiles: list[dict]) -> list[list[dict]]:
    """One box in each tile, from its place: stands in for a model."""
    return [[{"class_id": int((t["x"] + t["y"]) % 25), "score": 0.5 + (t["x"] % 40) / 100, "box": (10.0, 12.0, 40.0, 44.0)}] for t in tiles]


@query("O30")
def o30(spark, d):
    t = spark.range(25).select(F.col("id").cast("int").alias("class_id"), F.lit(0.3).alias("threshold"))
    return inference.run_pipeline(view(spark, d, "img"), demo_detector, t, 64, 0.25, 2.0, 0.5)


@query("O31")
def o31(spark, d):
    def small_memory(rows: list[dict]) -> list[list[dict]]:
        if len(rows) > 3:
            raise MemoryError
        return demo_detector(rows)

    return inference.detect(inference.tiles(view(spark, d, "img"), 64, 0.25), small_memory).groupBy("image_id").agg(F.count("*").alias("boxes"))
