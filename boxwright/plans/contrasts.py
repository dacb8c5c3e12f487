"""Queries over views that leave rows on both sides of a rule: few truths, few boxes, two reports that differ, all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import curation, kernels, matching, metrics, search
from boxwright.plans import datasets
from boxwright.plans.boxes import EVAL, _j5_sql, _pairs, _vehicles
from boxwright.plans.registry import VIEWS, accept_sql, coarse_sql, iou_sql, query, view
from boxwright.sources import sinks

VIEWS["rare"] = VIEWS["truth"] + " WHERE event_id % 25 = 0"


@query("J6_few", f"""WITH {_j5_sql("ord % 30 = 0", "ord % 10 = 1")}, {_j5_sql("ord % 30 = 0", "ord % 10 = 2", "2")}, l AS (SELECT * FROM lab WHERE reason <> 'duplicate_main'), r AS (SELECT * FROM lab2 WHERE reason <> 'duplicate_main'),
ff AS (SELECT image_id, m.p AS l_ord, m.t AS r_ord FROM (SELECT image_id, unnest({accept_sql('l', 'k.p = x.p OR k.t = x.t')}) AS m FROM (SELECT l.image_id, list({{'p': l.ord, 't': r.ord}} ORDER BY l.score DESC, l.ord, r.score DESC, r.ord) AS l
FROM l JOIN r ON l.image_id = r.image_id WHERE {iou_sql('l', 'r')} >= 0.35::DOUBLE GROUP BY l.image_id)))
SELECT ff.image_id, l_ord, r_ord, label FROM ff JOIN lab ON lab.ord = l_ord""", ("det", "truth"))  # fmt: skip
def j6_few(spark, d):
    det, t = _vehicles(view(spark, d, "det")), _vehicles(view(spark, d, "truth"))
    return matching.consensus(det.where("ord % 30 = 0"), det.where("ord % 10 = 1"), det.where("ord % 10 = 2"), t)


NO_RARE = datasets.NO_TRUTH.replace("FROM truth t", "FROM rare t")


@query("W2_rare", f"SELECT image_id, ord FROM ({datasets.RANKED} FROM det) c WHERE r <= 4 AND {NO_RARE}", ("det", "rare"))
def w2_rare(spark, d):
    df, order = datasets._crops(spark, d)
    return curation.quota_then_reject(df, view(spark, d, "rare"), ["image_id", "kind"], order, 4).select("image_id", "ord")


@query("W3_rare", f"SELECT image_id, ord FROM ({datasets.RANKED} FROM det c WHERE {NO_RARE}) WHERE r <= 2", ("det", "rare"))
def w3_rare(spark, d):
    df, order = datasets._crops(spark, d)
    return curation.reject_then_quota(df, view(spark, d, "rare"), ["image_id", "kind"], order, 2).select("image_id", "ord")


@query("O21_rare", f"""WITH s AS (SELECT d.*, {coarse_sql('class_id')} AS coarse FROM det d WHERE score >= 0.2::DOUBLE), l AS (SELECT s.*, stem, group_id, width, height FROM s JOIN img USING (image_id) WHERE coarse IN ('ship', 'vehicle')
  AND NOT EXISTS (SELECT 1 FROM rare t WHERE NOT t.difficult AND t.image_id = s.image_id AND {coarse_sql('t.class_id')} = coarse AND {iou_sql('s', 't')} >= CASE WHEN coarse = 'vehicle' THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END)),
c AS (SELECT *, {datasets._crop_sql('x1', 'x2', 'width')} AS cx, {datasets._crop_sql('y1', 'y2', 'height')} AS cy FROM l),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM rare t WHERE NOT t.difficult AND t.image_id = c.image_id AND c.cx - 1 < t.x2 AND t.x1 < c.cx + 11 AND c.cy - 1 < t.y2 AND t.y1 < c.cy + 11))
SELECT group_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, sha256('42:' || stem || ':' || ord)) AS r FROM f) WHERE r <= 4""", ("det", "rare", "img"))  # fmt: skip
def o21_rare(spark, d):
    return curation.hard_negatives(view(spark, d, "det"), view(spark, d, "rare"), view(spark, d, "img"), 0.2, 10, 1.0, 4).select("group_id", "ord")


@query("O25_changes", f"""WITH {EVAL}, pp AS (SELECT CAST(class_id AS VARCHAR) AS key, count(*) AS n FROM det WHERE score >= 0.5::DOUBLE GROUP BY 1), mm AS (SELECT key, count(*) AS tp FROM matched WHERE scope = 'fine' AND score >= 0.5::DOUBLE GROUP BY 1),
tt AS (SELECT CAST(class_id AS VARCHAR) AS key, count(*) AS t FROM truth WHERE NOT difficult GROUP BY 1), b AS (SELECT key, tp / t AS recall, (n - tp) / n AS fdr FROM pp JOIN mm USING (key) JOIN tt USING (key))
SELECT b.key, round(b.recall - report.recall, 9) AS recall_change, round(b.fdr - report.fdr, 9) AS fdr_change FROM b JOIN report ON report.scope = 'fine' AND report.key = b.key""", ("det", "truth"))  # fmt: skip
def o25_changes(spark, d):
    """All detections against those of half the score: a threshold keeps a prefix of the matching's order."""
    det, t = view(spark, d, "det"), view(spark, d, "truth")
    both = search.compare_reports(*metrics.reports_above(det, t, (None, 0.5), keys=("fine",)))
    return both.select("key", F.round("recall_change", 9).alias("recall_change"), F.round("fdr_change", 9).alias("fdr_change"))


@query("SNK13_rows", """WITH a AS (SELECT t.*, stem, least(x2, 100) AS r, least(y2, 100) AS b FROM truth t JOIN img USING (image_id) WHERE CAST(floor(image_id / 3) AS BIGINT) % 5 <> 0), i AS (SELECT stem, row_number() OVER (ORDER BY stem) AS image_id FROM (SELECT DISTINCT stem FROM a))
SELECT row_number() OVER (ORDER BY a.stem, ord) AS id, i.image_id AS image_id, class_id AS category_id, (r - x1) * (b - y1) AS area FROM a JOIN i USING (stem)""", ("truth", "img"))  # fmt: skip
def snk13_rows(spark, d):
    a = view(spark, d, "truth").join(datasets._assigned(spark, d).where("split = 'train'").select("image_id", "stem"), "image_id").drop("image_id").withColumns({"width": F.lit(100), "height": F.lit(100)})
    return sinks.coco_ground_truth(a).select("id", "image_id", "category_id", "area")


@query("G3_all", f"SELECT p.ord AS p_ord, count(*) AS n, count(*) FILTER ({iou_sql('p', 't')} = 0) AS apart, round(sum({iou_sql('p', 't')}), 6) AS total FROM det p JOIN truth t ON p.image_id = t.image_id GROUP BY p.ord", ("det", "truth"))
def g3_all(spark, d):
    """Every pair of an image, apart or not."""
    pairs = _pairs(spark, d, touching=False).select("p_ord", G.hbb_iou(G.box("p_"), G.box("t_")).alias("iou"))
    return pairs.groupBy("p_ord").agg(F.count("*").alias("n"), F.count_if(F.col("iou") == 0).alias("apart"), F.round(F.sum("iou"), 6).alias("total"))


@query("K1_all", f"""WITH p AS ({datasets.CS.format('det')}), t AS ({datasets.CS.format('truth')}), q AS (SELECT p.ord AS p_ord, (pow((p.cx - t.cx) / (p.w + 1e-7), 2) + pow((p.cy - t.cy) / (p.h + 1e-7), 2) + (pow((p.w - t.w) / (p.w + 1e-7), 2) + pow((p.h - t.h) / (p.h + 1e-7), 2)) / 4
 + pow((p.cx - t.cx) / (t.w + 1e-7), 2) + pow((p.cy - t.cy) / (t.h + 1e-7), 2) + (pow((p.w - t.w) / (t.w + 1e-7), 2) + pow((p.h - t.h) / (t.h + 1e-7), 2)) / 4) / 2 AS d FROM p JOIN t ON p.image_id = t.image_id)
SELECT p_ord, count(*) AS n, round(sum(exp(1e-6 - sqrt(d + 1e-12))), 6) AS total, round(min(exp(1e-6 - sqrt(d + 1e-12))), 8) AS least FROM q GROUP BY p_ord""", ("det", "truth"))  # fmt: skip
def k1_all(spark, d):
    """The similarity of every pair of an image: it is not 0 for boxes apart."""
    pairs = _pairs(spark, d, touching=False).select("p_ord", kernels.gaussian_similarity(G.box("p_"), G.box("t_")).alias("s"))
    return pairs.groupBy("p_ord").agg(F.count("*").alias("n"), F.round(F.sum("s"), 6).alias("total"), F.round(F.min("s"), 8).alias("least"))
