"""What searches and calibrations leave behind: thresholds, summaries and reports, in a folder.

Small documents (a row a class, fold or check) are written from the driver, each put in place at once. What grows with the images (reports by
image, out-of-fold predictions, assignments) goes out as ordered parts. Thresholds are written only by what passed its checks; a failed run
removes those of an earlier one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators import metrics, search
from boxwright.operators.calibration import Verdict
from boxwright.sources import documents
from boxwright.sources.sinks import markdown_table, write_artifacts
from boxwright.taxonomy import TAXONOMIES

#: How many of the seven metrics must improve; the metrics of a comparison, and those that are better when lower.
LEAST_IMPROVED = 6
SEVEN = tuple(f"{n}_{m}" for n in ("aircraft", "ship", "vehicle") for m in ("recall", "fdr")) + ("seconds",)
LOWER = tuple(n for n in SEVEN if n.endswith("fdr")) + ("seconds",)


def _classes(thresholds: Mapping[int, float]) -> dict:
    return {"class_thresholds": {int(c): float(t) for c, t in sorted(thresholds.items())}}


def _objective(o: search.Objective) -> dict:
    return {"tp": o.tp, "fp": o.fp, "fn": o.fn, "recall": o.recall, "fdr": o.fdr, "f1": o.f1}


def _report_folder(report: DataFrame, folder: str, name: str) -> None:
    documents.write_report(report, f"file://{Path(folder).resolve()}/{name}")


def write_thresholds(folder: str, thresholds: Mapping[int, float], objective: search.Objective, report: DataFrame, grid: Sequence[float], recall_floor: float, baseline: DataFrame | None = None, name: str = "experiment", baseline_name: str = "baseline") -> list[str]:
    """optimized-thresholds.yaml, search-summary.json and .md, report.json (parts), and with a baseline report comparison.json and .md."""
    summary = {"experiment_name": name, "grid": list(grid), "recall_floor": recall_floor, "objective": _objective(objective), "thresholds": {str(c): t for c, t in sorted(thresholds.items())}}
    made: dict[str, object] = {"optimized-thresholds.yaml": _classes(thresholds)}
    table = markdown_table([{"class": c, "threshold": t} for c, t in sorted(thresholds.items())])
    verdict = "keeps" if objective.recall >= recall_floor else "does not keep"
    if baseline is not None:
        rows = [r.asDict() for r in search.compare_reports(baseline.where("scope <> 'image'"), report.where("scope <> 'image'")).orderBy("scope", "key").collect()]  # at most the taxonomy
        overall = next(r for r in rows if r["scope"] == "overall")
        summary["baseline_objective"] = _objective(search.Objective(overall["a_tp"], overall["a_fp"], overall["a_fn"]))
        made["comparison.json"] = {"baseline": baseline_name, "experiment": name, "rows": rows}
        made["comparison.md"] = f"# {name} against {baseline_name}\n\n" + markdown_table([{k: r[k] for k in ("scope", "key", "a_recall", "b_recall", "recall_change", "a_fdr", "b_fdr", "fdr_change")} for r in rows])
    made["search-summary.json"] = summary
    made["search-summary.md"] = f"# Thresholds of {name}\n\nRecall {objective.recall:.6f}, FDR {objective.fdr:.6f}; it {verdict} the floor of {recall_floor}.\n\n{table}"
    _report_folder(report, folder, "report.json")
    return [*write_artifacts(folder, made), "report.json"]


def improved_items(report: DataFrame, baseline: Mapping[str, search.Objective]) -> tuple[int, dict]:
    """How many of the recalls and FDRs by coarse class better the baseline's, and the scores by class."""
    own = {r["key"]: search.Objective(r["tp"], r["fp"], r["fn"]) for r in report.where("scope = 'coarse'").collect()}
    better = lambda a, b: (a.recall > b.recall + 1e-12) + (a.fdr < b.fdr - 1e-12)
    scores = {n: {"recall": own[n].recall, "fdr": own[n].fdr, "recall_gain": own[n].recall - b.recall, "fdr_gain": b.fdr - own[n].fdr} for n, b in sorted(baseline.items())}
    return sum(better(own[n], b) for n, b in baseline.items()), scores


def write_ranking(folder: str, thresholds: Mapping[int, float], report: DataFrame, baseline: Mapping[str, search.Objective]) -> list[str]:
    """optimized-thresholds.yaml, summary.json with the gate (all six recalls and FDRs improved), report.json (parts)."""
    improved, scores = improved_items(report, baseline)
    _report_folder(report, folder, "report.json")
    summary = {"improved_accuracy_items": improved, "single_weight_gate_passed": improved >= LEAST_IMPROVED, "group_scores": scores}
    return [*write_artifacts(folder, {"optimized-thresholds.yaml": _classes(thresholds), "summary.json": summary}), "report.json"]


def write_competition(folder: str, report: DataFrame, name: str, seconds: float | None = None) -> list[str]:
    """competition-proxy.json and .md of a report and a latency (none: unknown)."""
    frame = report.where("scope = 'overall'").select("recall", "fdr", F.lit(seconds).cast("double").alias("seconds"))
    row = search.competition(frame).first().asDict()
    coarse = [r.asDict() for r in report.where("scope = 'coarse'").orderBy("key").collect()]
    proxy = {"experiment_name": name, **row, "ranking": {r["key"]: {"recall": r["recall"], "fdr": r["fdr"]} for r in coarse}}
    text = f"# {name}: {row['verdict']}\n\n" + markdown_table([{"signal": k, "value": "unknown" if v is None else v} for k, v in row.items()]) + "\n" + markdown_table([{"class": r["key"], "recall": r["recall"], "fdr": r["fdr"]} for r in coarse])
    return write_artifacts(folder, {"competition-proxy.json": proxy, "competition-proxy.md": text})


def seven_values(report: DataFrame, seconds: float) -> DataFrame:
    """(metric, value): recall and FDR of each coarse class, and the latency."""
    long = report.where("scope = 'coarse'").select(F.explode(F.array(*[F.struct(F.concat("key", F.lit(f"_{m}")).alias("metric"), F.col(m).alias("value")) for m in ("recall", "fdr")])).alias("m")).select("m.*")
    return long.unionByName(report.sparkSession.createDataFrame([("seconds", float(seconds))], "metric string, value double"))


def write_seven(folder: str, baseline: DataFrame, experiment: DataFrame, baseline_seconds: float, experiment_seconds: float) -> list[str]:
    """seven-metric-comparison.json and .md."""
    rows, total = search.seven_metrics(seven_values(baseline, baseline_seconds), seven_values(experiment, experiment_seconds), LOWER, LEAST_IMPROVED)
    told = {r["metric"]: r.asDict() for r in rows.collect()}
    lines = [{"metric": n, "baseline": told[n]["before"], "experiment": told[n]["after"], "delta": told[n]["after"] - told[n]["before"], "status": told[n]["outcome"]} for n in SEVEN]
    body = {"metrics": lines, **total.first().asDict()}
    return write_artifacts(folder, {"seven-metric-comparison.json": body, "seven-metric-comparison.md": "# Seven metrics\n\n" + markdown_table(lines)})


def _fold_thresholds(final: Mapping[str, float], taxonomy: str) -> dict:
    spans = TAXONOMIES[taxonomy]
    if "threshold" in final:
        return {"global_threshold": final["threshold"], **_classes({c: final["threshold"] for _, a, b in spans for c in range(a, b + 1)})}
    own = {c: final["ship_threshold" if n == "ship" else "general_threshold"] for n, a, b in spans for c in range(a, b + 1)}
    return {"strategy": "ship-override", "ship_threshold": final["ship_threshold"], "general_threshold": final["general_threshold"], **_classes(own)}


def out_of_fold_predictions(detections: DataFrame, folds: DataFrame, verdict: Verdict, taxonomy: str) -> DataFrame:
    """The detections that each fold's own choice keeps of its images."""
    from boxwright.taxonomy import coarse_of

    names = [c for c in ("threshold", "ship_threshold", "general_threshold") if c in verdict.folds.columns]
    joined = detections.join(folds, "image_id").join(F.broadcast(verdict.folds.select("fold", *names)), "fold")  # a row a fold
    bound = F.col("threshold") if "threshold" in names else F.when(coarse_of(F.col("class_id"), taxonomy) == "ship", F.col("ship_threshold")).otherwise(F.col("general_threshold"))
    return joined.where(F.col("score") >= bound).select(*detections.columns)


def write_calibration(folder: str, verdict: Verdict, detections: DataFrame, truth: DataFrame, folds: DataFrame, base_config: Mapping[str, object] | None = None, taxonomy: str = "scenes25") -> list[str]:
    """calibration-summary.json, fold-results.json; as parts fold-assignments.json, oof-report.json and oof-predictions.json. Only if it passed
    calibrated-thresholds.yaml and, with a base configuration, calibrated-config.yaml; a base configuration of a failed run raises."""
    if base_config is not None and not verdict.passed:
        raise ValueError("a failed calibration publishes no configuration")
    root = f"file://{Path(folder).resolve()}"
    checks = {r["name"]: {k: r[k] for k in ("value", "limit", "passed")} | {"operator": ">=" if r["at_least"] else "<="} for r in verdict.checks.orderBy("name").collect()}
    results = [r.asDict() for r in verdict.folds.orderBy("fold").collect()]  # a row a fold
    summary = {"status": "passed" if verdict.passed else "failed", "failure_reason": verdict.reason, "final": verdict.final, "acceptance": checks}
    only = ("calibrated-thresholds.yaml", "calibrated-config.yaml")
    made: dict[str, object] = {"calibration-summary.json": summary, "fold-results.json": results, only[0]: None, only[1]: None}
    if verdict.passed:
        made[only[0]] = _fold_thresholds(verdict.final, taxonomy)
        if base_config is None:
            del made[only[1]]
        else:
            made[only[1]] = {**base_config, "class_thresholds": made[only[0]]["class_thresholds"]}
    names = write_artifacts(folder, made, verdict.passed, only)
    documents.write_object(folds.select(F.col("image_id").cast("string").alias("key"), F.col("fold").cast("string").alias("body")), f"{root}/fold-assignments.json")
    kept = out_of_fold_predictions(detections, folds, verdict, taxonomy)
    box = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    documents.write_coco(kept.select("image_id", "ord", F.col("class_id").alias("category_id"), box.alias("bbox"), "score"), f"{root}/oof-predictions.json")
    names += ["fold-assignments.json", "oof-predictions.json"]
    if verdict.final:
        documents.write_report(metrics.evaluate(kept, truth, taxonomy), f"{root}/oof-report.json")
        names.append("oof-report.json")
    return names
