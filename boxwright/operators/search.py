"""Threshold searches, calibration and comparisons.

Counts per candidate are distributed: every candidate is a row, all are matched in one job, and only the candidates'
counts (as many rows as the grid and its folds) reach the driver, where ordered choices are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxwright.functions import scalar as S
from boxwright.operators import folds, matching
from boxwright.operators.small import small
from boxwright.sources.scratch import cut
from boxwright.taxonomy import coarse_of


@dataclass(frozen=True)
class Objective:
    tp: int
    fp: int
    fn: int

    @property
    def recall(self) -> float:
        return self.tp / (self.tp + self.fn) if self.tp + self.fn else 0.0

    @property
    def fdr(self) -> float:
        return self.fp / (self.tp + self.fp) if self.tp + self.fp else 0.0

    @property
    def f1(self) -> float:
        n = 2 * self.tp + self.fp + self.fn
        return 2 * self.tp / n if n else 0.0


EPSILON = 0.0005


def is_better(a: Objective, b: Objective, eps: float = EPSILON) -> bool:
    """Greater F1; of those within eps a lower FDR; of those a greater recall. Not transitive, so choices fold in order."""
    for x, y in ((a.f1, b.f1), (-a.fdr, -b.fdr), (a.recall, b.recall)):
        if abs(x - y) > eps:
            return x > y
    return False


def select_best(candidates: Sequence[tuple[float, Objective]], recall_floor: float, eps: float = EPSILON) -> tuple[float, Objective]:
    """Of those that keep the floor (else of all), the first that no later one betters."""
    pool = [c for c in candidates if c[1].recall >= recall_floor] or list(candidates)
    best = pool[0]
    for c in pool[1:]:
        if is_better(c[1], best[1], eps):
            best = c
    return best


def candidate_counts(detections: DataFrame, truth: DataFrame, candidates: DataFrame, key: str = "all", taxonomy: str = "scenes25", edges: DataFrame | None = None) -> DataFrame:
    """(candidate, image_id, tp, fp, fn). `candidates`: (candidate, class_id, threshold), a small table of complete maps.

    The IoU pairs are computed once, by the caller (`edges`) if it asks for more than one set of candidates. A per-class map does not keep a prefix of the score order, so each
    candidate is matched by itself, as one more grouping key of the same job.
    """
    edges = cut(matching.candidate_edges(detections, truth, (key,), taxonomy)) if edges is None else edges
    classes = detections.select("image_id", "ord", "class_id", "score")
    wide = classes.join(small(candidates), "class_id").where(F.col("score") >= F.col("threshold")).select("candidate", "image_id", "ord")
    kept = wide.join(edges.withColumnRenamed("p_ord", "ord"), ["image_id", "ord"]).withColumnRenamed("ord", "p_ord")
    # of one scope; images first, as candidates are few and would leave the sort nearly all its comparisons
    found = matching.resolve(kept, ("image_id", "candidate") if key == "all" else ("image_id", "candidate", "key")).groupBy("candidate", "image_id").agg(F.count("*").alias("tp"))
    n = wide.groupBy("candidate", "image_id").agg(F.count("*").alias("n"))
    t = truth.where(~F.col("difficult")).groupBy("image_id").agg(F.count("*").alias("t"))
    images = detections.select("image_id").union(truth.select("image_id")).distinct()
    every = images.crossJoin(small(candidates.select("candidate").distinct()))  # images x the grid
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = every.join(n, ["candidate", "image_id"], "left").join(found, ["candidate", "image_id"], "left").join(t, "image_id", "left")
    tp = zero("tp")
    return joined.select("candidate", "image_id", tp.alias("tp"), (zero("n") - tp).alias("fp"), (zero("t") - tp).alias("fn"))


def _objectives(counts: DataFrame) -> dict[int, Objective]:
    return {r[0]: Objective(r[1], r[2], r[3]) for r in counts.groupBy("candidate").agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).orderBy("candidate").collect()}


#: Pairs that a row of packed pairs holds at most.
PIECE = 4096


def _packed(edges: DataFrame, grid: Sequence[float], classes: Sequence[int]) -> DataFrame:
    """Pairs in the order of the walk, a row an image: (image_id, piece, whole, p, t, code). `p` and `t` number the ends within the image; `code`
    holds the class and how many thresholds of the grid (ascending) the score reaches. An image of more than PIECE pairs has several rows, not `whole`."""
    level = sum((F.coalesce((F.col("score") >= float(v)).cast("int"), F.lit(0)) for v in grid), F.lit(0))
    code = F.col("class_id") * (len(grid) + 1) + level
    # pairs that no map of the grid keeps end before the shuffle
    held = edges.where(F.col("class_id").isin(*classes) & (F.lit(0) < level))
    rows = held.select("image_id", code.cast("int").alias("code"), "score", "p_ord", "iou", "t_ord")
    image = rows.schema["image_id"]
    schema = StructType([image, *StructType.fromDDL("piece int, whole boolean, p array<int>, t array<int>, code array<int>")])
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, kind = [], pa.null()
        open_, piece, ends, parts = None, 0, ({}, {}), ([], [], [])

        def close(whole: bool) -> None:
            done.append((open_, piece, whole, *(pa.array(x, pa.int32()) for x in parts)))
            for x in parts:
                x.clear()

        def table() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(list(zip(*done))[:3], (kind, pa.int32(), pa.bool_()))]
            for k in range(3, 6):
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(d[k]) for d in done)]), pa.int32()), pa.concat_arrays([d[k] for d in done])).cast(lists))
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kind = batch.column("image_id"), batch.schema.field("image_id").type
            starts = [0, *(np.flatnonzero(folds._changes(folds._plain(keys))) + 1).tolist(), batch.num_rows]
            p, t, codes = (batch.column(c).to_pylist() for c in ("p_ord", "t_ord", "code"))
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                key = keys[start].as_py()
                if key != open_:
                    if open_ is not None:
                        close(piece == 0)
                    open_, piece, ends = key, 0, ({}, {})
                while start < end:
                    if len(parts[0]) == PIECE:
                        close(False)
                        piece += 1
                    stop = min(end, start + PIECE - len(parts[0]))
                    for part, own, given in zip(parts, ends, (p, t)):
                        part += [own.setdefault(x, len(own)) for x in given[start:stop]]
                    parts[2].extend(codes[start:stop])
                    start = stop
            if done:
                yield table()
        if open_ is not None:
            close(piece == 0)
            yield table()

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walk = [F.desc("score"), F.col("p_ord"), F.desc("iou"), F.col("t_ord")]
    return rows.repartition(n, "image_id").sortWithinPartitions("image_id", *walk).mapInArrow(run, schema)


def _walked(packed: DataFrame, kept: np.ndarray) -> dict[int, int]:
    """True positives of each candidate. kept[candidate, code]: does its map keep detections of that code? Whole images are walked where they lie;
    only the pieces of larger ones are shuffled."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [0] * len(kept)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column("p")).to_numpy()
            base = np.repeat(np.cumsum(sizes, dtype=np.int64) - sizes, sizes)
            p, t = (batch.column(c).flatten().to_numpy() + base for c in "pt")
            code = batch.column("code").flatten().to_numpy()
            for i, keep in enumerate(kept):
                at, lefts, rights = keep[code], bytearray(len(code)), bytearray(len(code))
                for a, b in zip(p[at].tolist(), t[at].tolist()):
                    if not (lefts[a] or rights[b]):
                        lefts[a] = rights[b] = 1
                        found[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(kept)), pa.int32()), pa.array(found, pa.int64())], names=["candidate", "tp"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, image, taken = [0] * len(kept), None, []
        for batch in batches:
            for row in range(batch.num_rows):
                if (key := batch.column("image_id")[row].as_py()) != image:
                    image, taken = key, [(set(), set()) for _ in kept]
                p, t, code = (batch.column(c)[row].values.to_numpy() for c in ("p", "t", "code"))
                for i, (keep, (lefts, rights)) in enumerate(zip(kept, taken)):
                    at = keep[code]
                    for a, b in zip(p[at].tolist(), t[at].tolist()):
                        if a not in lefts and b not in rights:
                            lefts.add(a)
                            rights.add(b)
                            found[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(kept)), pa.int32()), pa.array(found, pa.int64())], names=["candidate", "tp"])

    n, out = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "candidate int, tp bigint"
    small_ones = packed.where("whole").select("p", "t", "code").mapInArrow(whole, out)
    large_ones = packed.where("not whole").drop("whole").repartition(n, "image_id").sortWithinPartitions("image_id", "piece").mapInArrow(pieces, out)
    return {r[0]: r[1] for r in small_ones.unionByName(large_ones).groupBy("candidate").agg(F.sum("tp")).collect()}


def optimize_thresholds(detections: DataFrame, truth: DataFrame, grid: Sequence[float], recall_floor: float, taxonomy: str = "scenes25", passes: int = 2) -> tuple[dict[int, float], Objective]:
    """The best global threshold, then class by class (those that occur) the best for that class with the others held.

    Pairs are written once, in the order of the walk and an image a row, so a step of the search reads them and shuffles hardly anything. What a map
    keeps is a sum over counts by class and threshold; only its true positives need the walk. No map is walked twice.
    """
    from boxwright.operators.filters import n_classes

    classes, grid = range(n_classes(taxonomy)), sorted(set(grid))
    packed = cut(_packed(matching.candidate_edges(detections, truth, ("all",), taxonomy, carry=("class_id",)), grid, classes))
    over = [F.count_if(F.col("score") >= float(v)).alias(f"n{i}") for i, v in enumerate(grid)]
    counted = {r[0]: r[1:] for r in detections.where("image_id is not null").groupBy("class_id").agg(*over).collect()}  # at most the taxonomy
    truths = truth.where(~F.col("difficult") & F.col("image_id").isNotNull()).count()
    known: dict[tuple[int, ...], Objective] = {}

    def scored(maps: list[dict[int, float]]) -> list[tuple[float, Objective]]:
        at = [tuple(grid.index(m[c]) for c in classes) for m in maps]
        if new := [m for m in dict.fromkeys(at) if m not in known]:
            kept = np.array([[level > i for i in m for level in range(len(grid) + 1)] for m in new])
            hits = _walked(packed, kept)
            for i, m in enumerate(new):
                tp, n = hits.get(i, 0), sum(counted[c][m[c]] for c in classes if c in counted)
                known[m] = Objective(tp, n - tp, truths - tp)
        return [known[m] for m in at]

    best_t, best = select_best(list(zip(grid, scored([dict.fromkeys(classes, t) for t in grid]))), recall_floor)
    current = dict.fromkeys(classes, best_t)
    present = sorted(c for c in counted if c in classes)
    for _ in range(passes):
        for c in present:
            t, o = select_best(list(zip(grid, scored([current | {c: t} for t in grid]))), recall_floor)
            if is_better(o, best):
                current, best = current | {c: t}, o
    return current, best


def ranking_score(candidate: Objective, base: Objective) -> tuple:
    """Lexicographic gain of a coarse class over its baseline: both rates improved, how many did, the lesser gain counted in
    single detections (only if both did), the gains' sum, more hits, fewer false ones."""
    gains = candidate.recall - base.recall, base.fdr - candidate.fdr
    units = gains[0] * max(1, base.tp + base.fn), gains[1] * max(1, base.tp + base.fp)
    better = [g > 1e-12 for g in gains]
    return all(better), sum(better), min(units) if all(better) else float("-inf"), sum(units), candidate.tp, -candidate.fp


def _of_group(df: DataFrame, coarse: str, taxonomy: str) -> DataFrame:
    return df.where(coarse_of(F.col("class_id"), taxonomy) == coarse)


def group_counts(detections: DataFrame, truth: DataFrame, coarse: str, maps: Sequence[dict[int, float]], taxonomy: str, edges: DataFrame | None = None) -> list[Objective]:
    """Counts of one coarse class by itself under each map, all in one job; `edges` as for candidate_counts, of that class."""
    of = lambda df: _of_group(df, coarse, taxonomy)
    frame = detections.sparkSession.createDataFrame([(i, c, float(t)) for i, m in enumerate(maps) for c, t in m.items()], "candidate int, class_id int, threshold double")
    found = _objectives(candidate_counts(of(detections), of(truth), frame, taxonomy=taxonomy, edges=edges))
    return [found.get(i, Objective(0, 0, 0)) for i in range(len(maps))]


def optimize_ranking(detections: DataFrame, truth: DataFrame, baseline: dict[str, Objective], grid: Sequence[float], taxonomy: str = "scenes25", passes: int = 2) -> dict[int, float]:
    """Per coarse class the best common threshold (the first of equals), then class by class a strictly better one."""
    from boxwright.taxonomy import TAXONOMIES

    grid, out = sorted(set(grid)), {}
    spans = {n: range(low, high + 1) for n, low, high in TAXONOMIES[taxonomy]}
    for group in sorted(spans):
        rank = lambda o, g=group: ranking_score(o, baseline[g])
        edges = cut(matching.candidate_edges(*(_of_group(df, group, taxonomy) for df in (detections, truth)), ("all",), taxonomy))
        scored = group_counts(detections, truth, group, [dict.fromkeys(spans[group], t) for t in grid], taxonomy, edges)
        at = max(range(len(grid)), key=lambda i: (rank(scored[i]), -i))
        current, best = dict.fromkeys(spans[group], grid[at]), rank(scored[at])
        for _ in range(passes):
            for c in spans[group]:
                maps = [current | {c: t} for t in grid]
                scored = group_counts(detections, truth, group, maps, taxonomy, edges)
                at = max(range(len(grid)), key=lambda i: (rank(scored[i]), -i))
                if rank(scored[at]) > best:
                    current, best = maps[at], rank(scored[at])
        out |= current
    return out


def threshold_counts(detections: DataFrame, truth: DataFrame, grid: Sequence[float], taxonomy: str = "scenes25") -> DataFrame:
    """(image_id, threshold, tp, fp, fn) for global thresholds, from one matching (the sweep's argument, per image)."""
    matched = matching.greedy_match(detections, truth, ("all",), taxonomy).select("image_id", F.col("p_ord").alias("ord")).withColumn("tp", F.lit(1))
    scored = detections.select("image_id", "ord", "score").join(matched, ["image_id", "ord"], "left")
    levels = F.array(*[F.lit(float(t)) for t in sorted(set(grid))])
    wide = scored.withColumn("threshold", F.explode(levels)).where("score >= threshold").groupBy("image_id", "threshold").agg(F.count("tp").alias("tp"), F.count("*").alias("n"))
    t = truth.where(~F.col("difficult")).groupBy("image_id").agg(F.count("*").alias("t"))
    images = detections.select("image_id").union(truth.select("image_id")).distinct().withColumn("threshold", F.explode(levels))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    joined = images.join(wide, ["image_id", "threshold"], "left").join(t, "image_id", "left")
    return joined.select("image_id", "threshold", zero("tp").alias("tp"), (zero("n") - zero("tp")).alias("fp"), (zero("t") - zero("tp")).alias("fn"))


def pair_counts(detections: DataFrame, truth: DataFrame, general: Sequence[float], ship: Sequence[float], taxonomy: str = "scenes25") -> DataFrame:
    """(candidate, image_id, tp, fp, fn) for pairs (general, ship threshold); candidate = general index x len(ship) + ship index."""
    spark = detections.sparkSession
    from boxwright.operators.filters import n_classes

    rows = [(i * len(ship) + j, g, s) for i, g in enumerate(general) for j, s in enumerate(ship)]
    pairs = spark.createDataFrame(rows, "candidate int, general double, ship double")
    classes = spark.range(n_classes(taxonomy)).select(F.col("id").cast("int").alias("class_id"))
    maps = pairs.crossJoin(F.broadcast(classes)).select("candidate", "class_id", F.when(coarse_of(F.col("class_id"), taxonomy) == "ship", F.col("ship")).otherwise(F.col("general")).alias("threshold"))
    return candidate_counts(detections, truth, maps, taxonomy=taxonomy)


def fold_totals(counts: DataFrame, folds: DataFrame, candidate: str) -> DataFrame:
    """(fold, candidate, training and holdout counts): each image was matched once; folds only add."""
    # as many rows as the grid and its folds; read twice here and again by the choice, each time with a matching if not written
    per = cut(counts.join(folds, "image_id").groupBy("fold", candidate).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    total = per.groupBy(candidate).agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    joined = per.join(F.broadcast(total), candidate)  # as many rows as the grid
    return joined.select("fold", candidate, *[(F.col(f"all_{c}") - F.col(c)).alias(f"train_{c}") for c in ("tp", "fp", "fn")], *[F.col(c).alias(f"hold_{c}") for c in ("tp", "fp", "fn")])


def gated_choice(totals: DataFrame, candidate: str, least_recall: Column, most_fdr: Column, tie: float = 0.0001, first: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Per fold the candidate that passes both gates with the greatest training F1; of those within `tie` of it the one of lowest
    FDR, greatest recall, lowest candidate (columns in `first`, ascending, go before). Folds in which none passes are absent."""
    tp, fp, fn = (F.col(f"train_{c}") for c in ("tp", "fp", "fn"))
    scored = totals.withColumn("f1", S.f1(tp, fp, fn)).withColumn("recall", S.recall(tp, fn)).withColumn("fdr", S.false_discovery(tp, fp))
    passing = scored.where((F.col("recall") >= least_recall) & (F.col("fdr") <= most_fdr) & (F.lit(True) if where is None else where))
    tied = passing.join(passing.groupBy("fold").agg(F.max("f1").alias("_top")), "fold").where(F.col("f1") >= F.col("_top") - tie)
    order = F.struct(*[F.col(c) for c in first], F.col("fdr"), (-F.col("recall")).alias("r"), F.col(candidate))
    best = F.min_by(F.struct(candidate, "f1", "recall", "fdr", "hold_tp", "hold_fp", "hold_fn"), order)
    return tied.groupBy("fold").agg(best.alias("b")).select("fold", "b.*")


def calibrate(detections: DataFrame, truth: DataFrame, folds: DataFrame, grid: Sequence[float], baseline: float, recall_slack: float = 0.01, fdr_slack: float = 0.01, baseline_detections: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Per fold: the counts of the baseline's detections over its threshold on the other folds set a recall floor and an FDR cap;
    the gated best is chosen there and judged on the fold. The final threshold is the upper median of the folds' choices."""
    # one matching for the grid and, where it is of the same detections, the baseline
    both = cut(fold_totals(threshold_counts(detections, truth, [*grid, *([baseline] if baseline_detections is None else [])]), folds, "threshold"))
    totals = both.where(F.col("threshold").isin(*map(float, grid)))
    before = both.where(F.col("threshold") == float(baseline)) if baseline_detections is None else cut(fold_totals(threshold_counts(baseline_detections, truth, [baseline]), folds, "threshold"))
    tp, fp, fn = (F.col(f"train_{c}") for c in ("tp", "fp", "fn"))
    floor, cap = F.greatest(F.lit(0.0), S.recall(tp, fn) - recall_slack), F.least(F.lit(1.0), S.false_discovery(tp, fp) + fdr_slack)
    chosen = gated_choice(totals.join(before.select("fold", floor.alias("floor"), cap.alias("cap")), "fold"), "threshold", F.col("floor"), F.col("cap"))
    rows = chosen.orderBy("fold").collect()  # as many as folds
    out = Objective(sum(r["hold_tp"] for r in rows), sum(r["hold_fp"] for r in rows), sum(r["hold_fn"] for r in rows))
    picked = sorted(r["threshold"] for r in rows)
    n_folds = folds.select("fold").distinct().count()
    return chosen, {"passed": len(rows) == n_folds, "threshold": picked[len(picked) // 2] if picked else None, "recall": out.recall, "fdr": out.fdr}


def acceptance(checks: DataFrame) -> DataFrame:
    """(name, value, limit, at_least) with passed."""
    return checks.withColumn("passed", F.when(F.col("at_least"), F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit")))


def compare_reports(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer comparison by (scope, key), zero-filled, with the changes of recall and FDR."""
    side = lambda df, p: df.select("scope", "key", *[F.col(c).alias(f"{p}_{c}") for c in ("tp", "fp", "fn", "recall", "fdr")])
    joined = side(left, "a").join(side(right, "b"), ["scope", "key"], "full_outer").na.fill(0)
    return joined.withColumn("recall_change", F.col("b_recall") - F.col("a_recall")).withColumn("fdr_change", F.col("b_fdr") - F.col("a_fdr"))


def competition(metrics: DataFrame, least_recall: float = 0.85, most_fdr: float = 0.20, most_seconds: float = 20.0) -> DataFrame:
    """(recall, fdr, seconds) judged: accuracy before timing; an unknown latency passes."""
    accurate = (F.col("recall") >= least_recall) & (F.col("fdr") <= most_fdr)
    quick = F.coalesce(F.col("seconds") <= most_seconds, F.lit(True))
    return metrics.withColumn("accuracy_passed", accurate).withColumn("latency_passed", quick).withColumn("verdict", F.when(~accurate, "accuracy_gate_failed").when(~quick, "timing_gate_failed").otherwise("pass_candidate"))


def seven_metrics(before: DataFrame, after: DataFrame, lower_is_better: Sequence[str] = (), least_improved: int = 6, tie: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(metric, value) tables compared: improved, tied or regressed; promoted if enough improve and none of the gates fail."""
    j = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric")
    gain = F.when(F.col("metric").isin(*lower_is_better), F.col("before") - F.col("after")).otherwise(F.col("after") - F.col("before"))
    outcome = F.when(F.abs(gain) <= tie, "tied").when(gain > 0, "improved").otherwise("regressed")
    rows = j.withColumn("outcome", outcome)
    return rows, rows.agg(F.count_if(F.col("outcome") == "improved").alias("improved"), F.count_if(F.col("outcome") == "regressed").alias("regressed")).withColumn("promote", F.col("improved") >= least_improved)
