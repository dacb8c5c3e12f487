"""Joins between boxes: ordered one-to-one matching and what builds on it.

Detections: image_id, class_id, ord, score, x1, y1, x2, y2. Truth: image_id, class_id, ord, x1, y1, x2, y2, difficult.
`ord` is the place in the input; it breaks every tie.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxwright.functions.geometry import BOX
from boxwright.operators import folds, spatial
from boxwright.sources.scratch import cut
from boxwright.taxonomy import TAXONOMIES, coarse_of, match_iou


def match_keys(class_id: Column, keys: tuple[str, ...], taxonomy: str) -> Column:
    made = {"all": F.lit("all"), "coarse": coarse_of(class_id, taxonomy), "fine": class_id.cast("string")}
    return F.array(*[F.struct(F.lit(k).alias("scope"), made[k].alias("key")) for k in keys])


def keyed(df: DataFrame, keys: tuple[str, ...], taxonomy: str) -> DataFrame:
    """A row per matching that the box takes part in."""
    return df.withColumn("_m", F.explode(match_keys(F.col("class_id"), keys, taxonomy))).select("*", "_m.scope", "_m.key").drop("_m")


def candidate_edges(detections: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("all", "coarse", "fine"), taxonomy: str = "scenes25", iou: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one image and key whose IoU reaches the truth's bound; pairs below it can never match, so they end here.
    A finer key divides a coarser one, so boxes are paired once, by the coarsest key asked for, and a pair takes part in each
    matching in which its keys agree. `carry`: columns of the detections that go with their pairs."""
    widest = next(k for k in ("all", "coarse", "fine") if k in keys)
    bound = F.lit(float(iou)) if iou is not None else match_iou(F.col("class_id"), taxonomy)
    own = {"all": [], "coarse": ["_within"], "fine": ["class_id"]}[widest]
    coarse = coarse_of(F.col("class_id"), taxonomy)
    # classes outside the taxonomy have no coarse key, but a fine one each
    within = {"_coarse": coarse, "_within": F.coalesce(coarse, F.col("class_id").cast("string"))}
    p, t = (df.withColumns(within) for df in (detections, truth.where(~F.col("difficult")).withColumn("_bound", bound)))
    names = ["image_id", "_coarse", "class_id", "ord"]
    fields = (names + ["score", *carry], names + ["_bound"])
    # the least bound that a detection can meet: that of its coarse class, if it meets no other
    least = (F.least(*[match_iou(F.lit(low), taxonomy) for _, low, _ in TAXONOMIES[taxonomy]], F.lit(1.0)) if widest == "all" else bound) if iou is None else bound
    near = spatial.overlapping_pairs(p, t, ["image_id", *own], fields, least=(least, F.col("_bound"))) if iou is None or iou > 0 else spatial.pairs_at(p, t, ["image_id", *own], iou, fields)
    pairs = near.where("iou >= r._bound")
    key = {"all": lambda s: F.lit("all"), "coarse": lambda s: F.col(f"{s}._coarse"), "fine": lambda s: F.col(f"{s}.class_id").cast("string")}
    told = ["l.image_id", *[F.col(f"l.{c}") for c in carry]]
    ends = ["l.score", F.col("l.ord").alias("p_ord"), F.col("r.ord").alias("t_ord"), "iou"]
    if len(keys) == 1:
        # a literal scope takes no part in the sort of the walk
        return pairs.where(key[keys[0]]("l") == key[keys[0]]("r")).select(*told, F.lit(keys[0]).alias("scope"), key[keys[0]]("r").alias("key"), *ends)
    parts = F.array(*[F.when(key[k]("l") == key[k]("r"), F.struct(F.lit(k).alias("scope"), key[k]("r").alias("key"))) for k in keys])
    wide = pairs.withColumn("m", F.explode(F.filter(parts, lambda x: x.isNotNull())))
    return wide.select(*told, "m.scope", "m.key", *ends)


def resolve(edges: DataFrame, group: tuple[str, ...] = ("image_id", "scope", "key")) -> DataFrame:
    """One-to-one matches: detections by falling score then place, each takes its best free truth (the first of equals)."""
    rows = edges.select(*group, "p_ord", "t_ord", "iou", "score")
    return folds.one_to_one(rows, list(group), [F.desc("score"), F.col("p_ord"), F.desc("iou"), F.col("t_ord")], "p_ord", "t_ord")


def greedy_match(detections: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("all", "coarse", "fine"), taxonomy: str = "scenes25", iou: float | None = None) -> DataFrame:
    return resolve(candidate_edges(detections, truth, keys, taxonomy, iou))


def model_outcomes(models: DataFrame, truth: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """Coarse matches of several models at once: a detections table with a `model` column."""
    edges = candidate_edges(models, truth, ("coarse",), taxonomy, carry=("model",))
    return resolve(edges, ("image_id", "model", "scope", "key")).select("model", "image_id", F.col("key").alias("coarse"), "p_ord", "t_ord", "iou", "score")


def false_positive_sources(detections: DataFrame, truth: DataFrame, taxonomy: str = "scenes25") -> DataFrame:
    """Detections that match nothing of their coarse class: source 'overlap' if they touch any truth of that class, even a
    claimed one, else 'background'."""
    matched = greedy_match(detections, truth, ("coarse",), taxonomy).select("image_id", F.col("p_ord").alias("ord"))
    left = detections.withColumn("coarse", coarse_of(F.col("class_id"), taxonomy)).join(matched, ["image_id", "ord"], "left_anti")
    t = truth.where(~F.col("difficult")).withColumn("coarse", coarse_of(F.col("class_id"), taxonomy))
    touching = spatial.overlapping_pairs(left, t, ["image_id", "coarse"], (["ord"], [])).select("l.image_id", "l.ord").distinct()
    return left.join(touching.withColumn("hit", F.lit(True)), ["image_id", "ord"], "left").withColumn("source", F.when(F.col("hit"), "overlap").otherwise("background")).drop("hit")


def overlapping(left: DataFrame, right: DataFrame, iou: float, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of left (known by image_id and ord) with (left_semi) or without (left_anti) a row of right of the same keys at that IoU."""
    hit = spatial.pairs_at(left, right, on, iou, (["image_id", "ord"], [])).select("l.image_id", "l.ord").distinct()
    return left.join(hit, ["image_id", "ord"], how)


def first_overlapping_truth(detections: DataFrame, truth: DataFrame, iou: float, on: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Each detection with the lowest place of a truth it overlaps, null if none."""
    found = spatial.pairs_at(detections, truth, list(on), iou, (["image_id", "ord"], ["ord"]))
    hit = found.groupBy("l.image_id", "l.ord").agg(F.min("r.ord").alias("t_ord"))
    return detections.join(hit, ["image_id", "ord"], "left")


def _claims(main: DataFrame, wanted: DataFrame, truth: DataFrame, iou: float, apart: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposals that overlap the main model's detections (again), pairs of the others with truth, `taken` if the main model claims it
    (near), and what the others win (won). `apart`: columns that tell models of proposals, each of which claims for itself."""
    row = ["image_id", *apart, "ord"]
    by_main = greedy_match(main, truth, ("all",), iou=iou).select("image_id", "t_ord", F.lit(True).alias("taken"))
    # each of these is read more than once
    again = cut(spatial.pairs_at(wanted, main, ["image_id"], iou, (row, [])).select(*[F.col(f"l.{c}") for c in row]).distinct())
    edges = candidate_edges(wanted.join(again, row, "left_anti"), truth, ("all",), iou=iou, carry=apart)
    near = cut(edges.join(by_main, ["image_id", "t_ord"], "left"))
    won = cut(resolve(near.where("taken is null"), ("image_id", *apart, "scope", "key")).select("image_id", *apart, F.col("p_ord").alias("ord"), F.col("t_ord").alias("won")))
    return again, near, won


def label_proposals(main: DataFrame, proposals: DataFrame, truth: DataFrame, class_id: int = 24, iou: float = 0.35) -> DataFrame:
    """Proposals with matched truth, label and reason.

    The main model claims truth first. A proposal that overlaps a detection of the main model is duplicate_main and claims
    nothing. Of the others, by falling score, each claims the best free truth (recoverable_truth); one that finds none is
    duplicate_proposal, with the first claimed truth it overlaps, or background. A truth that a proposal overlaps but did not
    get was claimed before its turn, so the claims at the end decide.
    """
    of = lambda df: df.where(F.col("class_id") == class_id)
    wanted = of(proposals)
    again, near, won = _claims(of(main), wanted, of(truth), iou)
    claimed = won.select("image_id", F.col("won").alias("t_ord"), F.lit(True).alias("later"))
    over = near.join(claimed, ["image_id", "t_ord"], "left").where("taken or later").groupBy("image_id", F.col("p_ord").alias("ord")).agg(F.min("t_ord").alias("held"))
    joined = wanted.join(won, ["image_id", "ord"], "left").join(again.withColumn("duplicate", F.lit(True)), ["image_id", "ord"], "left").join(over, ["image_id", "ord"], "left")
    reason = F.when(F.col("duplicate"), "duplicate_main").when(F.col("won").isNotNull(), "recoverable_truth").when(F.col("held").isNotNull(), "duplicate_proposal").otherwise("background")
    return joined.withColumn("matched", F.coalesce("won", "held")).withColumn("label", F.col("won").isNotNull().cast("int")).withColumn("reason", reason).drop("duplicate", "won", "held")


def first_fit_pairs(left: DataFrame, right: DataFrame, iou: float) -> DataFrame:
    """One-to-one consensus of two models: left by falling score takes the first free right (by falling score) that overlaps
    enough, not the best one."""
    found = spatial.pairs_at(left, right, ["image_id"], iou, (["ord", "score"], ["ord", "score"]))
    edges = found.select("l.image_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("ord", "score")])
    taken = folds.one_to_one(edges, ["image_id"], [F.desc("l_score"), F.col("l_ord"), F.desc("r_score"), F.col("r_ord")], "l_ord", "r_ord")
    return taken.select("image_id", "l_ord", "r_ord")


def consensus(main: DataFrame, first: DataFrame, second: DataFrame, truth: DataFrame, class_id: int = 24, iou: float = 0.35) -> DataFrame:
    """Proposals of two models that agree, one to one in first-fit order: (image_id, l_ord, r_ord, label of the first's)."""
    of = lambda df: df.where(F.col("class_id") == class_id)
    # both models go through each join together
    told = [of(p).select("image_id", "class_id", "ord", "score", *BOX, F.lit(i).alias("_model")) for i, p in enumerate((first, second))]
    wanted = told[0].unionByName(told[1])
    again, _, won = _claims(of(main), wanted, of(truth), iou, ("_model",))
    rest = cut(wanted.join(again, ["image_id", "_model", "ord"], "left_anti"))
    a, b = (rest.where(F.col("_model") == i).drop("_model") for i in range(2))
    label = won.where("_model = 0").select("image_id", F.col("ord").alias("l_ord"), F.lit(1).alias("label"))
    return first_fit_pairs(a, b, iou).join(label, ["image_id", "l_ord"], "left").na.fill(0, ["label"])


def ap_match(detections: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Matches of average precision, per class and threshold: each detection keeps its best truth, then each truth its
    best-scored detection. Two windows, no fold: this is not the greedy matching."""
    found = spatial.pairs_at(detections, truth, ["image_id", "class_id"], min(thresholds), (["ord", "score"], ["ord"]))
    edges = found.select("l.image_id", "l.class_id", F.col("l.ord").alias("p_ord"), F.col("r.ord").alias("t_ord"), "l.score", "iou")
    # a detection's best truth is the same at every threshold that it reaches
    best = Window.partitionBy("image_id", "p_ord").orderBy(F.desc("iou"), "t_ord")
    edges = edges.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    edges = edges.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds]))).where("iou >= threshold")
    own = Window.partitionBy("image_id", "t_ord", "threshold").orderBy(F.desc("score"), "p_ord")
    return edges.withColumn("_r", F.row_number().over(own)).where("_r = 1").select("image_id", "class_id", "p_ord", "t_ord", "threshold", "iou")


def hamming_pairs(hashes: DataFrame, most: int = 6, key: str = "stem", group: str = "group_id", bits: str = "phash", within: Column | None = None) -> DataFrame:
    """Unordered pairs of different groups whose 64-bit hashes (16 hex digits) differ in at most `most` < 8 bits. Eight bands of
    each eighth bit, so that a byte of few values weakens none of them much: so few flipped bits leave 8 - most bands untouched, so pairs
    that agree in two of them (one, for 7) lose none. `within`: a string that both of a pair must have in common."""
    if most > 7:
        raise ValueError("eight bands only find pairs that differ in at most 7 bits")
    half = lambda at: F.conv(F.substring(bits, at, 8), 16, 10).cast("bigint")
    parsed = hashes.select(F.col(key).alias("k"), F.col(group).alias("g"), (F.lit("") if within is None else within).alias("w"), half(1).alias("hi"), half(9).alias("lo"))

    def eighth(c: str, i: int) -> Column:
        v = F.shiftright(c, i).bitwiseAND(F.lit(0x01010101))
        return v.bitwiseOR(F.shiftright(v, 7)).bitwiseOR(F.shiftright(v, 14)).bitwiseOR(F.shiftright(v, 21)).bitwiseAND(F.lit(15))

    told = parsed.select("*", *[(eighth("hi", i) * 16 + eighth("lo", i)).alias(f"_{i}") for i in range(8)])
    bands = [sum((F.col(f"_{i}") * 256**n for n, i in enumerate(which)), F.lit(at << 16)) for at, which in enumerate(combinations(range(8), min(2, 8 - most)))]
    n = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # many times the rows that are read: in as many partitions as asked for, never broadcast
    wide = told.select("k", "g", "w", "hi", "lo", F.explode(F.array(*bands)).alias("band")).repartition(n, "band")
    a, b = wide.alias("a"), wide.alias("b").hint("merge")
    apart = F.bit_count(F.col("a.hi").bitwiseXOR(F.col("b.hi"))) + F.bit_count(F.col("a.lo").bitwiseXOR(F.col("b.lo")))
    near = (F.col("a.k") < F.col("b.k")) & (apart <= most) & (F.col("a.g") != F.col("b.g"))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.w") == F.col("b.w")) & near)
    return pairs.select(F.col("a.k").alias("left"), F.col("b.k").alias("right"), apart.alias("distance")).distinct()


def complete_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join that raises if a left row has no partner."""
    joined = left.join(right.withColumn("_there", F.lit(True)), on, "left")
    missing = F.concat(F.lit(f"no partner for {on} "), F.col(on).cast("string"))
    return joined.where(F.when(F.col("_there").isNull(), F.raise_error(missing).cast("boolean")).otherwise(F.lit(True))).drop("_there")


def paired(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer pairing of two listings by key: 'paired', 'left only' or 'right only'."""
    a, b = left.select(on).distinct().withColumn("_l", F.lit(True)), right.select(on).distinct().withColumn("_r", F.lit(True))
    state = F.when(F.col("_l") & F.col("_r"), "paired").when(F.col("_l"), "left only").otherwise("right only")
    return a.join(b, on, "full_outer").select(on, state.alias("state"))
