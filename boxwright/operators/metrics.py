"""Counts and reports. A report is a long table: scope, key, tp, fp, fn, recall, fdr."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions import scalar as S
from boxwright.functions.geometry import BOX
from boxwright.operators import matching
from boxwright.operators.small import small
from boxwright.sources.scratch import cut
from boxwright.taxonomy import COARSE, TAXONOMIES, coarse_of, dimension

REPORT = ("scope", "key", "tp", "fp", "fn", "recall", "fdr")


def flags(detections: DataFrame, truth: DataFrame, taxonomy: str = "scenes25", keys: tuple[str, ...] = ("all", "coarse", "fine")) -> DataFrame:
    """(image_id, scope, key, tp, fp, fn) counts of one pass over all keyings."""
    keyed = lambda df: matching.keyed(df, keys, taxonomy).groupBy("image_id", "scope", "key").agg(F.count("*").alias("n"))
    found = matching.greedy_match(detections, truth, keys, taxonomy).groupBy("image_id", "scope", "key").agg(F.count("*").alias("n"))
    part = lambda df, name: df.select("image_id", "scope", "key", *[(F.col("n") if c == name else F.lit(0)).cast("bigint").alias(c) for c in ("p", "t", "m")])
    every = part(keyed(detections), "p").unionByName(part(keyed(truth.where(~F.col("difficult"))), "t")).unionByName(part(found, "m"))
    summed = every.groupBy("image_id", "scope", "key").agg(*[F.sum(c).alias(c) for c in ("p", "t", "m")])
    return summed.select("image_id", "scope", "key", F.col("m").alias("tp"), (F.col("p") - F.col("m")).alias("fp"), (F.col("t") - F.col("m")).alias("fn"))


def rated(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("recall", S.recall(tp, fn)).withColumn("fdr", S.false_discovery(tp, fp))


def report_keys(spark, taxonomy: str) -> DataFrame:
    names = sorted({n for n, _, _ in TAXONOMIES[taxonomy]})
    rows = [("overall", "all")] + [("coarse", n) for n in names]
    fine = dimension(spark, taxonomy).select(F.lit("fine").alias("scope"), F.col("class_id").cast("string").alias("key"))
    return spark.createDataFrame(rows, "scope string, key string").unionByName(fine)


def evaluate(detections: DataFrame, truth: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """Overall (class-agnostic), coarse, fine and per-image counts; each keying is a matching of its own, and every class of
    the taxonomy has a row."""
    counts = cut(flags(detections, truth, taxonomy))  # read below for the keyings and again for the images
    overall = counts.withColumn("scope", F.when(F.col("scope") == "all", "overall").otherwise(F.col("scope")))
    images = overall.where("scope = 'overall'").withColumn("scope", F.lit("image")).withColumn("key", F.col("image_id").cast("string"))
    long = overall.unionByName(images).groupBy("scope", "key").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    named = report_keys(detections.sparkSession, taxonomy).join(long.where("scope <> 'image'"), ["scope", "key"], "left")
    full = named.unionByName(long.where("scope = 'image'").select(*named.columns))
    return rated(full.select("scope", "key", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")])).select(*REPORT)


def reports_above(detections: DataFrame, truth: DataFrame, scores: Sequence[float | None], taxonomy: str = "scenes25", keys: tuple[str, ...] = ("all", "coarse", "fine")) -> list[DataFrame]:
    """Reports, without images, of the detections of at least each score (None: of all). They are one matching, as a threshold
    keeps a prefix of its order."""
    above = [F.lit(True) if s is None else F.coalesce(F.col("score") >= s, F.lit(False)) for s in scores]
    totals = lambda df, name: df.groupBy("scope", "key").agg(*[F.count_if(v).alias(f"{name}{i}") for i, v in enumerate(above)])
    p = totals(matching.keyed(detections, keys, taxonomy), "p")
    m = totals(matching.greedy_match(detections, truth, keys, taxonomy), "m")
    t = matching.keyed(truth.where(~F.col("difficult")), keys, taxonomy).groupBy("scope", "key").agg(F.count("*").alias("t"))
    counts = p.join(m, ["scope", "key"], "full_outer").join(t, ["scope", "key"], "full_outer")
    # a row a key, read by each report
    counts = cut(counts.withColumn("scope", F.when(F.col("scope") == "all", "overall").otherwise(F.col("scope"))))
    asked = report_keys(detections.sparkSession, taxonomy).where(F.col("scope").isin(*["overall" if k == "all" else k for k in keys]))
    named = asked.join(counts, ["scope", "key"], "left").na.fill(0)
    side = lambda i: named.select("scope", "key", F.col(f"m{i}").alias("tp"), (F.col(f"p{i}") - F.col(f"m{i}")).alias("fp"), (F.col("t") - F.col(f"m{i}")).alias("fn"))
    return [rated(side(i)).select(*REPORT) for i in range(len(scores))]


def false_positive_audit(detections: DataFrame, truth: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """(coarse, overlap, background, total)."""
    found = matching.false_positive_sources(detections, truth, taxonomy).groupBy("coarse").agg(F.count_if(F.col("source") == "overlap").alias("overlap"), F.count_if(F.col("source") == "background").alias("background"))
    names = detections.sparkSession.createDataFrame([(n,) for n in COARSE], "coarse string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = names.join(found, "coarse", "left")
    return joined.select("coarse", zero("overlap").alias("overlap"), zero("background").alias("background"), (zero("overlap") + zero("background")).alias("total"))


def class_counts(detections: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """(scope, key, n) for every coarse and fine class, zero-filled."""
    found = matching.keyed(detections, ("coarse", "fine"), taxonomy).groupBy("scope", "key").agg(F.count("*").alias("n"))
    keys = report_keys(detections.sparkSession, taxonomy).where("scope <> 'overall'")
    return keys.join(found, ["scope", "key"], "left").select("scope", "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def audit_statistics(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(statistic, key, n): boxes and distinct images per class, image sizes, modes, groups."""
    part = lambda df, name, key, n: df.groupBy(key.cast("string").alias("key")).agg(n.cast("bigint").alias("n")).select(F.lit(name).alias("statistic"), "key", "n")
    return (
        part(annotations, "targets", F.col("class_id"), F.count("*"))
        .unionByName(part(annotations, "images", F.col("class_id"), F.countDistinct("image_id")))
        .unionByName(part(images, "size", F.concat_ws("x", "width", "height"), F.count("*")))
        .unionByName(part(images, "mode", F.col("mode"), F.count("*")))
        .unionByName(images.agg(F.countDistinct("group_id").alias("n")).select(F.lit("groups").alias("statistic"), F.lit("all").alias("key"), "n"))
    )


def split_counts(annotations: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """Boxes per split, coarse and fine class."""
    return annotations.groupBy("split", coarse_of(F.col("class_id"), taxonomy).alias("coarse"), "class_id").agg(F.count("*").alias("n"))


def durations(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, median, 95th percentile (linear between ranks) and maximum; exact, not approximate."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.median(v).alias("median"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max"))


def latency_gate(df: DataFrame, value: str, limit: float, reserve: float, *keys: str) -> DataFrame:
    """Passed only if every sample keeps the reserve."""
    return durations(df, value, *keys).join(df.groupBy(*keys).agg(F.every(F.col(value) <= F.lit(limit - reserve)).alias("passed")), list(keys)) if keys else df.agg(F.every(F.col(value) <= F.lit(limit - reserve)).alias("passed"))


def complementarity(models: DataFrame, truth: DataFrame, left: str, right: str, taxonomy: str = "scenes25") -> DataFrame:
    """Per coarse class: truths that both, one or either model finds, and the recall of the union."""
    found = matching.model_outcomes(models, truth, taxonomy)
    # one matching for both: a join of the two sides would make it twice
    by = found.where(F.col("model").isin(left, right)).groupBy("coarse", "image_id", "t_ord")
    both = by.agg(*[F.bool_or(F.col("model") == m).alias(n) for m, n in ((left, "_left"), (right, "_right"))])
    a, b = F.col("_left"), F.col("_right")
    counts = both.groupBy("coarse").agg(F.count_if(a & b).alias("shared"), F.count_if(a & ~b).alias("left_only"), F.count_if(b & ~a).alias("right_only"), F.count("*").alias("either"))
    total = truth.where(~F.col("difficult")).groupBy(coarse_of(F.col("class_id"), taxonomy).alias("coarse")).agg(F.count("*").alias("truths"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = total.join(counts, "coarse", "left")
    return joined.select("coarse", *[zero(c).alias(c) for c in ("shared", "left_only", "right_only", "either")], "truths").withColumn("oracle_recall", S.rate(F.col("either"), F.col("truths")))


AP_THRESHOLDS = [0.5 + 0.05 * i for i in range(10)]
#: Recalls at which precision is averaged, and points of the confidence axis.
RECALL_POINTS, CONFIDENCE_POINTS = 101, 1000
SMOOTHED = 0.1


def ranked_in_ranges(df: DataFrame, key: str, order: list[Column], sums: list[str], place: str = "k") -> DataFrame:
    """df with `place`, each row's rank in order within its key, and with the columns `sums` replaced by their sums up to the row.

    No task holds a key: rows are ranged by (key, order), ranks and sums are made within a range, and what the ranges before hold of the key is
    added. Only a key that goes on from one range to the next has something to add, so there are fewer such rows than ranges.
    """
    ranged = cut(df.repartitionByRange(F.col(key), *order).withColumn("_p", F.spark_partition_id()))
    shares = ranged.groupBy(key, "_p").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums)])
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    told = ["_n", *[f"_s{i}" for i in range(len(sums))]]
    offsets = shares.select(key, "_p", *[F.sum(c).over(before).alias(f"{c}_o") for c in told]).where("_n_o > 0")
    within = Window.partitionBy(key, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({place: F.count("*").over(within), **{c: F.sum(c).over(within) for c in sums}}).join(F.broadcast(offsets), [key, "_p"], "left")
    more = lambda c, o: F.col(c) + F.coalesce(o, F.lit(0))
    return rows.withColumns({place: more(place, "_n_o"), **{c: more(c, f"_s{i}_o") for i, c in enumerate(sums)}}).drop("_p", *[f"{c}_o" for c in told])


def _judged(detections: DataFrame, truth: DataFrame, max_detections: int, thresholds: list[float], dedupe: bool) -> tuple[DataFrame, DataFrame]:
    """The best max_detections of each image by falling score within their class, with rank k, hit_0 .. (does it match at that threshold?) and
    tp_0 .. (how many have, up to it); and (class_id, truths)."""
    truth = truth.where(~F.col("difficult"))
    if dedupe:
        first = Window.partitionBy("image_id", "class_id", *BOX).orderBy("ord")
        truth = truth.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    top = Window.partitionBy("image_id").orderBy(F.desc("score"), "ord")
    p = detections.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= max_detections).select("image_id", "class_id", "ord", "score", *BOX)
    at = F.array_position(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("threshold")) - 1
    hits = matching.ap_match(p, truth, thresholds).groupBy("image_id", F.col("p_ord").alias("ord")).agg(F.collect_set(at).alias("_at"))  # of at most the thresholds
    flag = lambda i: F.coalesce(F.array_contains("_at", F.lit(i).cast("bigint")), F.lit(False)).cast("int")
    marked = p.join(hits, ["image_id", "ord"], "left").select("class_id", "image_id", "ord", "score", *[flag(i).alias(f"hit_{i}") for i in range(len(thresholds))])
    marked = marked.withColumns({f"tp_{i}": F.col(f"hit_{i}") for i in range(len(thresholds))})
    total = truth.groupBy("class_id").agg(F.count("*").alias("truths"))
    return ranked_in_ranges(marked, "class_id", [F.desc("score"), F.col("image_id"), F.col("ord")], [f"tp_{i}" for i in range(len(thresholds))]), total


def _area(ranked: DataFrame, total: DataFrame, thresholds: list[float]) -> DataFrame:
    """(class_id, threshold, truths, ap). The envelope at a recall is the best precision of a hit of greater recall: hits are counted into the last
    point that they exceed, and a class has one row a point."""
    joined = ranked.join(small(total), "class_id")  # a row a class
    hits = F.filter(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"hit_{i}").alias("hit"), (F.col(f"tp_{i}") / F.col("truths")).alias("r"), (F.col(f"tp_{i}") / F.col("k")).alias("p")) for i, t in enumerate(thresholds)]), lambda h: h["hit"] == 1)
    each = joined.select("class_id", F.explode(hits).alias("h")).select("class_id", "h.threshold", "h.r", "h.p")
    last, step = RECALL_POINTS - 1, 1 / (RECALL_POINTS - 1)
    x = lambda g: F.when(g == last, 1.0).otherwise(g * F.lit(step))
    near = F.ceil(F.col("r") * last).cast("int") - 1
    point = F.when(x(near) >= F.col("r"), near - 1).when(x(near + 1) < F.col("r"), near + 1).otherwise(near)
    best = each.withColumn("g", point).groupBy("class_id", "threshold", "g").agg(F.max("p").alias("p"))
    points = best.groupBy("class_id", "threshold").agg(F.collect_list(F.struct("g", "p")).alias("c"))  # at most a point each
    height = lambda i: F.coalesce(F.array_max(F.transform(F.filter("c", lambda e: e["g"] >= i), lambda e: e["p"])), F.lit(0.0))
    heights = F.transform(F.sequence(F.lit(0), F.lit(last)), height)
    area = F.aggregate(F.sequence(F.lit(1), F.lit(last)), F.lit(0.0), lambda s, i: s + (F.get("y", i - 1) + F.get("y", i)) / 2 * step)
    found = points.withColumn("y", heights).select("class_id", "threshold", area.alias("ap"))
    levels = total.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return levels.join(found, ["class_id", "threshold"], "left").select("class_id", "threshold", "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def average_precision(detections: DataFrame, truth: DataFrame, max_detections: int = 300, thresholds: list[float] | None = None, dedupe: bool = True) -> DataFrame:
    """(class_id, threshold, truths, ap): area under the precision envelope over 101 recall points, joined by lines.

    At most max_detections of an image by score; exact duplicate truths count once. Classes without truths have no row.
    """
    thresholds = thresholds or AP_THRESHOLDS
    return _area(*_judged(detections, truth, max_detections, thresholds, dedupe), thresholds)


def _curves(ranked: DataFrame, total: DataFrame) -> DataFrame:
    """(class_id, g, p, r): precision and recall at the first threshold by confidence, at each point of a common axis; between two
    scores by a line, above the greatest 1 and 0, below the least as there. A class has at most two rows a point."""
    last = CONFIDENCE_POINTS - 1
    x = lambda g: F.when(g == last, 1.0).otherwise(g * F.lit(1 / last))
    near = F.floor(F.col("score") * last).cast("int")
    held = F.greatest(F.lit(-1), F.least(F.lit(last), F.when(x(near) > F.col("score"), near - 1).when(x(near + 1) <= F.col("score"), near + 1).otherwise(near)))
    row = F.struct("score", (F.col("tp_0") / F.col("k")).alias("p"), (F.col("tp_0") / F.col("truths")).alias("r"))
    # the last point that a score reaches; per such point the first and the last row in order
    ends = ranked.join(small(total), "class_id").groupBy("class_id", held.alias("g")).agg(F.min_by(row, "k").alias("first"), F.max_by(row, "k").alias("last"))
    grid = total.select("class_id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("g")).join(ends, ["class_id", "g"], "full_outer")
    up, down = (Window.partitionBy("class_id").orderBy(o) for o in (F.col("g"), F.desc("g")))
    above = F.last("last", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))  # the last row that reaches the point
    below = F.last("first", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))  # the first that does not
    told = grid.withColumn("a", above).withColumn("b", below).where("g >= 0").join(small(total.select("class_id")), "class_id")

    def at(v: str, left: float) -> Column:
        line = F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * ((F.col("a.score") - x(F.col("g"))) / (F.col("a.score") - F.col("b.score")))
        return F.when(F.col("a").isNull() & F.col("b").isNull(), 0.0).when(F.col("a").isNull(), left).when(F.col("b").isNull(), F.col(f"a.{v}")).otherwise(line)

    return told.select("class_id", "g", at("p", 1.0).alias("p"), at("r", 0.0).alias("r"))


def detection_metrics(detections: DataFrame, truth: DataFrame, max_detections: int = 300, thresholds: list[float] | None = None, dedupe: bool = True) -> DataFrame:
    """(class_id, truths, precision, recall, f1, ap50, ap50_95) of each class that has truths: precision and recall at the confidence at which
    the smoothed mean F1 over the classes is greatest (the least such confidence). Raises if there is no truth."""
    thresholds = thresholds or AP_THRESHOLDS
    ranked, total = _judged(detections, truth, max_detections, thresholds, dedupe)
    ranked, total = cut(ranked), cut(total)
    if not total.limit(1).count():
        raise ValueError("no truth that is not difficult")
    curves = cut(_curves(ranked, total).withColumn("f1", 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + 1e-16)))
    mean = curves.groupBy("g").agg(F.avg("f1").alias("f1"))  # a row a point from here on
    half = (round(CONFIDENCE_POINTS * SMOOTHED * 2) // 2 + 1) // 2
    ends = mean.agg(F.min_by("f1", "g").alias("low"), F.max_by("f1", "g").alias("high"))
    beside = Window.orderBy("g").rowsBetween(-half, half)
    padded = F.greatest(F.lit(0), F.lit(half) - F.col("g")) * F.col("low") + F.greatest(F.lit(0), F.col("g") + half - CONFIDENCE_POINTS + 1) * F.col("high")
    smooth = mean.withColumn("s", F.sum("f1").over(beside)).crossJoin(F.broadcast(ends)).select("g", F.round((F.col("s") + padded) / (2 * half + 1), 12).alias("s"))
    best = smooth.agg(F.min_by("g", F.struct(-F.col("s"), "g")).alias("g"))
    chosen = curves.join(F.broadcast(best), "g").drop("g")
    ap = _area(ranked, total, thresholds).groupBy("class_id").agg(F.max(F.when(F.col("threshold") == thresholds[0], F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    return total.join(chosen, "class_id").join(ap, "class_id").select("class_id", "truths", F.col("p").alias("precision"), F.col("r").alias("recall"), "f1", "ap50", "ap50_95")


def mean_detection_metrics(per_class: DataFrame) -> DataFrame:
    """precision, recall, map50, map50_95: the means over the classes that have truths."""
    return per_class.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("ap50").alias("map50"), F.avg("ap50_95").alias("map50_95"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """map50 and map50_95 over the classes that have truths."""
    return ap.agg(F.avg(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))


def binary_average_precision(df: DataFrame, score: str, label: str, order: str, *keys: str) -> DataFrame:
    """Mean of the precision at each positive, ranked by falling score then order; 0 without positives. Ranks come from ranges, so
    neither a key nor a table without keys is one task."""
    told = df.select(F.struct(*keys, F.lit(0).alias("_all")).alias("_key"), F.col(score).alias("_score"), F.col(order).alias("_order"), F.col(label).cast("bigint").alias("y")).withColumn("tp", F.col("y"))
    ranked = ranked_in_ranges(told, "_key", [F.desc("_score"), F.col("_order")], ["tp"])
    return ranked.groupBy("_key").agg(F.coalesce(F.avg(F.when(F.col("y") == 1, F.col("tp") / F.col("k"))), F.lit(0.0)).alias("ap")).select(*[F.col(f"_key.{c}").alias(c) for c in keys], "ap")


def sampler_weights(df: DataFrame, label: str) -> DataFrame:
    """Each row with one over the count of its label: counts combine before the shuffle, and the few labels are broadcast."""
    counts = df.groupBy(label).agg((1.0 / F.count("*")).alias("weight"))
    return df.join(small(counts), label)


def group_statistics(images: DataFrame, annotations: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """Per source group: images, boxes, boxes by coarse class, and the classes present."""
    boxes = annotations.join(images.select("image_id", "group_id"), "image_id")
    coarse = coarse_of(F.col("class_id"), taxonomy)
    counts = boxes.groupBy("group_id").agg(
        F.count("*").alias("boxes"), *[F.count_if(coarse == n).alias(f"{n}_boxes") for n in COARSE], F.countDistinct("class_id").alias("classes")
    )
    n = images.groupBy("group_id").agg(F.count("*").alias("images"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("boxes", *[f"{n}_boxes" for n in COARSE], "classes")]
    return n.join(counts, "group_id", "left").select("group_id", "images", *zero)


def resample_accounting(annotations: DataFrame, factors: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """(coarse, original, duplicated, balanced) boxes when each image is repeated `factor` times."""
    n = annotations.join(factors, "image_id").groupBy(coarse_of(F.col("class_id"), taxonomy).alias("coarse")).agg(F.count("*").alias("original"), F.sum("factor").cast("bigint").alias("balanced"))
    return n.select("coarse", "original", (F.col("balanced") - F.col("original")).alias("duplicated"), "balanced")


def vehicle_fdr_feasible(tp: Column, fp: Column, limit: float) -> Column:
    return S.false_discovery(tp, fp) <= F.lit(limit)


def operating_curve(proposals: DataFrame, thresholds: list[float], base_tp: int, base_fp: int, truths: int, max_fdr: float) -> DataFrame:
    """Labelled proposals (score, label) swept: what each threshold adds to a base, and whether the limit still holds."""
    wide = proposals.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    n = wide.groupBy("threshold").agg(F.count_if((F.col("score") >= F.col("threshold")) & (F.col("label") == 1)).alias("added_tp"), F.count_if((F.col("score") >= F.col("threshold")) & (F.col("label") == 0)).alias("added_fp"))
    tp, fp = F.col("added_tp") + base_tp, F.col("added_fp") + base_fp
    return n.withColumn("recall", S.rate(tp, F.lit(truths))).withColumn("fdr", S.false_discovery(tp, fp)).withColumn("feasible", S.false_discovery(tp, fp) <= max_fdr)


def sweep(detections: DataFrame, truth: DataFrame, thresholds: list[float], taxonomy: str = "scenes25") -> DataFrame:
    """(place, threshold, tp, fp, fn, recall, fdr) of global thresholds, in input order.

    Filtering by one threshold keeps a prefix of the score order, so a single class-agnostic matching serves all: a
    detection's outcome does not depend on lower scores.
    """
    matched = matching.greedy_match(detections, truth, ("all",), taxonomy).select("image_id", F.col("p_ord").alias("ord")).withColumn("tp", F.lit(1))
    scored = detections.select("image_id", "ord", "score").join(matched, ["image_id", "ord"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)]))
    # counts per score combine first, so the explode works on distinct scores
    by_score = scored.groupBy("score").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    wide = by_score.select("*", levels.alias("l"))
    kept = F.col("score") >= F.col("l.threshold")
    n = wide.groupBy("l").agg(F.sum(F.when(kept, F.col("tp")).otherwise(0)).alias("tp"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n"))
    truths = truth.where(~F.col("difficult")).agg(F.count("*").alias("truths"))
    joined = n.crossJoin(F.broadcast(truths))  # one row
    counts = joined.select(F.col("l.place").alias("place"), F.col("l.threshold").alias("threshold"), "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"))
    return rated(counts)
