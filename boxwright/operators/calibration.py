"""Cross-validated thresholds with a verdict: each fold's choice is judged on the images it did not see.

A fold's holdout counts at its own choice add up to one out-of-fold report, in which every image counts once. The verdict holds that report, the
worst fold and the spread of the choices against limits; a final threshold exists only if every fold chose one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import scalar as S
from boxwright.operators import search
from boxwright.sources.scratch import cut
from boxwright.taxonomy import coarse_of

#: The default grid and the limits of the acceptance checks.
GRID = tuple(round(0.25 + i * 0.025, 3) for i in range(15))
SINGLE_LIMITS = {"oof_recall": 0.953772, "oof_fdr": 0.045037, "ship_recall": 0.80, "ship_fdr": 0.18, "threshold_range": 0.05}
PAIR_LIMITS = {"oof_recall": 0.953772, "oof_fdr": 0.045037, "ship_recall": 0.80, "ship_fdr": 0.18, "worst_fold_ship_fdr": 0.25, "ship_threshold_range": 0.05, "general_threshold_range": 0.05}
COUNTS = ("tp", "fp", "fn")


@dataclass(frozen=True)
class Verdict:
    """`folds`: a row per fold with its choice (null if none passed its gates) and holdout counts. `checks`: (name, value, limit, at_least,
    passed), empty if a fold has no choice. `final`: the upper median of the choices, by threshold name."""

    passed: bool
    reason: str | None
    folds: DataFrame
    checks: DataFrame
    final: dict[str, float] = field(default_factory=dict)


def _ships(df: DataFrame, taxonomy: str) -> DataFrame:
    return df.where(coarse_of(F.col("class_id"), taxonomy) == "ship")


def _gates(detections: DataFrame, truth: DataFrame, folds: DataFrame, threshold: float, recall_slack: float, fdr_slack: float, taxonomy: str) -> DataFrame:
    """(fold, floor, cap) from the counts of the baseline's detections on the other folds."""
    before = search.fold_totals(search.threshold_counts(detections, truth, [threshold], taxonomy), folds, "threshold")
    tp, fp, fn = (F.col(f"train_{c}") for c in COUNTS)
    return before.select("fold", F.greatest(F.lit(0.0), S.recall(tp, fn) - recall_slack).alias("floor"), F.least(F.lit(1.0), S.false_discovery(tp, fp) + fdr_slack).alias("cap"))


def out_of_fold(chosen: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, value) of the report put together from the folds' holdout counts (hold_*, ship_*), of the worst fold and of the spread of each threshold."""
    total = {c: F.sum(f"hold_{c}") for c in COUNTS} | {f"ship_{c}": F.sum(f"ship_{c}") for c in COUNTS}
    worst = F.max(S.false_discovery(F.col("ship_tp"), F.col("ship_fp")))
    spread = {f"{n}_range": F.max(n) - F.min(n) for n in names}
    one = chosen.agg(*[v.alias(n) for n, v in (total | {"worst": worst} | spread).items()])
    value = {
        "oof_recall": S.recall(F.col("tp"), F.col("fn")), "oof_fdr": S.false_discovery(F.col("tp"), F.col("fp")), "ship_recall": S.recall(F.col("ship_tp"), F.col("ship_fn")),
        "ship_fdr": S.false_discovery(F.col("ship_tp"), F.col("ship_fp")), "worst_fold_ship_fdr": F.col("worst"), **{n: F.col(n) for n in spread},
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in value.items()])).alias("c")).select("c.*")


def _verdict(chosen: DataFrame, folds: DataFrame, names: Sequence[str], limits: dict[str, float]) -> Verdict:
    """The choices of a few folds: from here on, tables of a row per fold or check."""
    spark = folds.sparkSession
    told = cut(folds.select("fold").distinct().join(chosen, "fold", "left"))
    rows = told.orderBy("fold").collect()
    none = [r["fold"] for r in rows if r[names[0]] is None]
    bounds = spark.createDataFrame([(n, float(v), "recall" in n) for n, v in limits.items()], "name string, limit double, at_least boolean")
    checks = cut(search.acceptance(out_of_fold(told, names).join(F.broadcast(bounds), "name")))
    if none or not rows:
        return Verdict(False, f"fold {none[0]} has no threshold that passes its gates" if none else "no folds", told, checks.where("false"))
    final = {n: sorted(r[n] for r in rows)[len(rows) // 2] for n in names}
    failed = [r["name"] for r in checks.where("not passed").orderBy("name").collect()]
    return Verdict(not failed, f"acceptance checks failed: {', '.join(failed)}" if failed else None, told, checks, final)


def calibrate_threshold(
    detections: DataFrame, truth: DataFrame, folds: DataFrame, grid: Sequence[float] = GRID, baseline: float = 0.25, baseline_detections: DataFrame | None = None,
    recall_slack: float = 0.005, fdr_slack: float = 0.005, tie: float = 0.0001, limits: dict[str, float] | None = None, taxonomy: str = "scenes25",
) -> Verdict:
    """One threshold for all classes; folds: (image_id, fold)."""
    gates = _gates(detections if baseline_detections is None else baseline_detections, truth, folds, baseline, recall_slack, fdr_slack, taxonomy)
    totals = search.fold_totals(search.threshold_counts(detections, truth, grid, taxonomy), folds, "threshold")
    chosen = search.gated_choice(totals.join(gates, "fold"), "threshold", F.col("floor"), F.col("cap"), tie)
    ship = _hold(search.threshold_counts(_ships(detections, taxonomy), _ships(truth, taxonomy), grid, taxonomy), folds, "threshold", "ship")
    return _verdict(_with_ship(chosen, ship, "threshold"), folds, ["threshold"], limits or SINGLE_LIMITS)


def _hold(counts: DataFrame, folds: DataFrame, by: str, prefix: str) -> DataFrame:
    return counts.join(folds, "image_id").groupBy("fold", by).agg(*[F.sum(c).alias(f"{prefix}_{c}") for c in COUNTS])


def _with_ship(chosen: DataFrame, ship: DataFrame, by: str) -> DataFrame:
    """A fold without ships counts none."""
    joined = chosen.join(ship, ["fold", by], "left")
    return joined.withColumns({f"ship_{c}": F.coalesce(f"ship_{c}", F.lit(0)) for c in COUNTS})


def calibrate_pair(
    detections: DataFrame, truth: DataFrame, folds: DataFrame, grid: Sequence[float] = GRID, baseline: float = 0.25, baseline_detections: DataFrame | None = None,
    recall_slack: float = 0.005, fdr_slack: float = 0.005, ship_floor: float = 0.80, ship_cap: float = 0.17, tie: float = 0.0001, limits: dict[str, float] | None = None, taxonomy: str = "scenes25",
) -> Verdict:
    """A threshold for ships and one for the other classes. A ship's matching does not depend on the other classes' threshold, so ship counts
    are those of one threshold. Of tied pairs: lowest ship FDR, lowest FDR, greatest recall, lowest ship, then lowest general threshold."""
    grid = sorted(set(grid))
    n = len(grid)
    gates = _gates(detections if baseline_detections is None else baseline_detections, truth, folds, baseline, recall_slack, fdr_slack, taxonomy)
    counts = search.pair_counts(detections, truth, grid, grid, taxonomy)  # candidate = general x n + ship
    totals = search.fold_totals(counts, folds, "candidate")
    ship = search.fold_totals(search.threshold_counts(_ships(detections, taxonomy), _ships(truth, taxonomy), grid, taxonomy), folds, "threshold")
    ship = cut(ship.select("fold", F.col("threshold").alias("ship_threshold"), *[F.col(f"{s}_{c}").alias(f"{'ship' if s == 'hold' else 'ship_train'}_{c}") for s in ("train", "hold") for c in COUNTS]))
    place = F.array(*[F.lit(float(t)) for t in grid])
    ship_at, general_at = (F.col("candidate") % n).cast("int"), F.floor(F.col("candidate") / n).cast("int")
    named = totals.withColumns({"ship_threshold": F.get(place, ship_at), "general_threshold": F.get(place, general_at)}).join(gates, "fold").join(ship, ["fold", "ship_threshold"], "left")
    named = named.withColumns({c: F.coalesce(c, F.lit(0)) for c in (f"{p}_{x}" for p in ("ship", "ship_train") for x in COUNTS)})
    ship_recall, ship_fdr = S.recall(F.col("ship_train_tp"), F.col("ship_train_fn")), S.false_discovery(F.col("ship_train_tp"), F.col("ship_train_fp"))
    # the number of a pair in the order of ship, then general threshold
    ordered = named.withColumns({"ship_fdr": ship_fdr, "ship_recall": ship_recall, "pair": ship_at * n + general_at})
    chosen = search.gated_choice(ordered, "pair", F.col("floor"), F.col("cap"), tie, first=("ship_fdr",), where=(F.col("ship_recall") >= ship_floor) & (F.col("ship_fdr") <= ship_cap))
    back = chosen.withColumns({"ship_threshold": F.get(place, F.floor(F.col("pair") / n).cast("int")), "general_threshold": F.get(place, (F.col("pair") % n).cast("int"))}).drop("pair")
    return _verdict(_with_ship(back, ship.select("fold", "ship_threshold", *[f"ship_{c}" for c in COUNTS]), "ship_threshold"), folds, ["ship_threshold", "general_threshold"], limits or PAIR_LIMITS)
