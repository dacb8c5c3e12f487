"""Command line over files: python -m boxwright.cli COMMAND ... Paths are anything that Spark reads; results go to stdout as
JSON lines, or to --out as a folder of JSON."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import scalar as S
from boxwright.operators import calibration, curation, matching, metrics, outlines, prepare, rasters, search, splitting, suppression
from boxwright.sources import readers
from boxwright.sources.configs import MultiscalePolicy, PipelineConfig
from boxwright.taxonomy import COARSE, TAXONOMIES

COMMANDS: dict[str, tuple[Callable, list[tuple[tuple, dict]]]] = {}
IOU = (("--iou",), {"type": float, "default": 0.5})


def command(name: str, *arguments: tuple[tuple, dict]):
    def keep(f):
        COMMANDS[name] = (f, list(arguments))
        return f

    return keep


def path(name: str, **more) -> tuple[tuple, dict]:
    return (name,), more


def _detections(spark: SparkSession, a: argparse.Namespace, where: str) -> DataFrame:
    return readers.coco_predictions(readers.whole_files(spark, where), a.taxonomy)


def _truth(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.coco_truth(readers.whole_files(spark, a.truth), a.taxonomy)


def _text(spark: SparkSession, where: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(where, wholetext=True).collect())  # one small file


def _grid(text: str) -> list[float]:
    values = sorted({float(v) for v in text.split(",")})
    if not all(0 <= v <= 1 for v in values):
        raise SystemExit(f"thresholds must lie in 0 .. 1: {text}")
    return values


GRID = (("--thresholds",), {"type": _grid, "default": [i / 20 for i in range(1, 20)]})


@command("evaluate", path("predictions"), path("truth"))
def evaluate(spark, a):
    return metrics.evaluate(_detections(spark, a, a.predictions), _truth(spark, a), a.taxonomy)


@command("evaluate-ap", path("predictions"), path("truth"), (("--max-detections",), {"type": int, "default": 300}))
def evaluate_ap(spark, a):
    return metrics.average_precision(_detections(spark, a, a.predictions), _truth(spark, a), a.max_detections)


@command("audit-false-positives", path("predictions"), path("truth"))
def audit(spark, a):
    return metrics.false_positive_audit(_detections(spark, a, a.predictions), _truth(spark, a), a.taxonomy)


@command("sweep-thresholds", path("predictions"), path("truth"), GRID)
def sweep(spark, a):
    return metrics.sweep(_detections(spark, a, a.predictions), _truth(spark, a), a.thresholds, a.taxonomy)


@command("optimize-thresholds", path("predictions"), path("truth"), GRID, (("--recall-floor",), {"type": float, "default": 0.0}), (("--passes",), {"type": int, "default": 2}))
def optimize(spark, a):
    chosen, best = search.optimize_thresholds(_detections(spark, a, a.predictions), _truth(spark, a), a.thresholds, a.recall_floor, a.taxonomy, a.passes)
    return spark.createDataFrame([(c, t, best.recall, best.fdr) for c, t in chosen.items()], "class_id int, threshold double, recall double, fdr double")


@command("optimize-ranking-thresholds", path("predictions"), path("truth"), path("baseline"), GRID, (("--passes",), {"type": int, "default": 2}))
def optimize_ranking(spark, a):
    rows = readers.report_json(readers.whole_files(spark, a.baseline)).where("scope = 'coarse'").collect()  # three
    base = {r["key"]: search.Objective(r["tp"], r["fp"], r["fn"]) for r in rows}
    if set(base) < {n for n, _, _ in TAXONOMIES[a.taxonomy]}:
        raise SystemExit("the baseline report lacks a coarse class")
    chosen = search.optimize_ranking(_detections(spark, a, a.predictions), _truth(spark, a), base, a.thresholds, a.taxonomy, a.passes)
    return spark.createDataFrame(sorted(chosen.items()), "class_id int, threshold double")


@command("calibrate-thresholds", path("predictions"), path("truth"), path("groups"), GRID, (("--folds",), {"type": int, "default": 5}), (("--baseline",), {"type": float, "default": 0.25}))
def calibrate(spark, a):
    """The folds' choices; exit status 2 if a fold has none."""
    groups = readers.image_groups(readers.whole_files(spark, a.truth), readers.whole_files(spark, a.groups))
    truth = _truth(spark, a)
    from boxwright.taxonomy import coarse_of

    folds = splitting.build_folds(splitting.group_vectors(groups, truth, coarse_of(F.col("class_id"), a.taxonomy)), a.folds)
    fold = spark.createDataFrame(sorted(folds.items()), "group_id string, fold int")
    chosen, verdict = search.calibrate(_detections(spark, a, a.predictions), truth, groups.join(fold, "group_id").select("image_id", "fold"), a.thresholds, a.baseline)
    print(verdict, file=sys.stderr)
    a.status = 0 if verdict["passed"] else 2
    return chosen


@command("apply-suppression", path("predictions"), IOU, (("--method",), {"choices": ("iou", "diou"), "default": "iou"}), (("--classes",), {"type": lambda s: [int(x) for x in s.split(",")], "required": True}))
def suppress(spark, a):
    rules = spark.createDataFrame([(c, a.method, a.iou) for c in a.classes], "class_id int, method string, threshold double")
    return suppression.suppress_classes(_detections(spark, a, a.predictions), rules)


@command("fuse-ranking-ensemble", path("aircraft"), path("ship"), path("vehicle"), path("supplement"), (("--aircraft-threshold",), {"type": float, "default": 0.25}), (("--ship-threshold",), {"type": float, "default": 0.31}), (("--vehicle-threshold",), {"type": float, "default": 0.25}), (("--supplement-threshold",), {"type": float, "default": 0.74}), (("--iou",), {"type": float, "default": 0.30}))
def fuse_ranking(spark, a):
    sources = {n: _detections(spark, a, getattr(a, n)) for n in ("aircraft", "ship", "vehicle", "supplement")}
    picks = {n: (n, getattr(a, f"{n}_threshold")) for n in COARSE}
    return suppression.fuse_ranking(sources, picks, ("supplement", a.supplement_threshold), a.iou)


@command("fuse-same-weight-multiscale", path("small"), path("middle"), path("large"), path("policy"))
def fuse_multiscale(spark, a):
    """The policy is YAML: class_thresholds, and for each of aircraft and ship a supplement threshold and a duplicate IoU."""
    p = MultiscalePolicy.from_yaml(_text(spark, a.policy))
    t = spark.createDataFrame([(c, float(v)) for c, v in p.class_thresholds.items()], "class_id int, threshold double")
    s, m, large = (_detections(spark, a, x) for x in (a.small, a.middle, a.large))
    return suppression.fuse_multiscale(s, m, large, t, p.pair("aircraft"), p.pair("ship"), float(p.vehicle_score_ceiling), float(p.vehicle_min_area))


@command("analyze-complementarity", path("left"), path("right"), path("truth"))
def complementarity(spark, a):
    models = readers.named_predictions({"left": _detections(spark, a, a.left), "right": _detections(spark, a, a.right)})
    return metrics.complementarity(models, _truth(spark, a), "left", "right", a.taxonomy).drop("left", "right")


@command("analyze-vehicle-proposals", path("main"), path("proposals"), path("truth"), (("--iou",), {"type": float, "default": 0.35}))
def proposals(spark, a):
    return matching.label_proposals(_detections(spark, a, a.main), _detections(spark, a, a.proposals), _truth(spark, a), iou=a.iou)


@command("analyze-vehicle-consensus", path("main"), path("first"), path("second"), path("truth"), (("--iou",), {"type": float, "default": 0.35}))
def consensus(spark, a):
    return matching.consensus(*(_detections(spark, a, x) for x in (a.main, a.first, a.second)), _truth(spark, a), iou=a.iou)


@command("compare-experiments", path("left"), path("right"))
def compare(spark, a):
    report = lambda p: readers.report_json(readers.whole_files(spark, p), slack=1e-6).where("scope <> 'image'")
    return search.compare_reports(report(a.left), report(a.right))


@command("competition-report", path("report"), (("--seconds",), {"type": float}))
def competition(spark, a):
    overall = readers.report_json(readers.whole_files(spark, a.report)).where("scope = 'overall'")
    return search.competition(overall.withColumn("seconds", F.lit(a.seconds).cast("double")))


@command("compare-seven-metrics", path("before"), path("after"), (("--seconds-before",), {"type": float, "required": True}), (("--seconds-after",), {"type": float, "required": True}))
def seven(spark, a):
    def long(p: str, seconds: float) -> DataFrame:
        coarse = readers.report_json(readers.whole_files(spark, p)).where("scope = 'coarse'")
        both = F.explode(F.array(*[F.struct(F.concat("key", F.lit(f"_{m}")).alias("metric"), F.col(m).alias("value")) for m in ("recall", "fdr")]))
        return coarse.select(both.alias("e")).select("e.*").union(spark.createDataFrame([("seconds", seconds)], "metric string, value double"))

    lower = [f"{n}_fdr" for n in COARSE] + ["seconds"]
    return search.seven_metrics(long(a.before, a.seconds_before), long(a.after, a.seconds_after), lower)[0]


@command("mine-hard-negatives", path("predictions"), path("truth"), path("images"), (("--min-score",), {"type": float, "default": 0.25}), (("--crop",), {"type": int, "default": 640}), (("--margin",), {"type": float, "default": 16.0}), (("--per-group",), {"type": int, "default": 2}))
def negatives(spark, a):
    return curation.hard_negatives(_detections(spark, a, a.predictions), _truth(spark, a), spark.read.parquet(a.images), a.min_score, a.crop, a.margin, a.per_group)


@command("mine-hard-examples", path("predictions"), path("truth"), path("images"), (("--floor",), {"type": float, "default": 0.25}), (("--crop",), {"type": int, "default": 640}), (("--positives",), {"type": int, "default": 8}), (("--negatives",), {"type": int, "default": 4}))
def examples(spark, a):
    return curation.hard_examples(_detections(spark, a, a.predictions), _truth(spark, a), spark.read.parquet(a.images), a.positives, a.negatives, a.floor, a.crop)


@command("find-duplicates", path("hashes"), (("--bits",), {"type": int, "default": 6}))
def duplicates(spark, a):
    """hashes: Parquet with stem, group_id, phash. Stems with their canonical one."""
    h = spark.read.parquet(a.hashes)
    return curation.duplicate_components(matching.hamming_pairs(h, a.bits), h)


@command("evaluate-detection-metrics", path("predictions"), path("truth"), (("--max-detections",), {"type": int, "default": 300}))
def evaluate_detection_metrics(spark, a):
    """Precision, recall, F1 and average precision of each class."""
    return metrics.detection_metrics(_detections(spark, a, a.predictions), _truth(spark, a), a.max_detections)


def _fold_verdict(spark, a, judge) -> DataFrame:
    """The checks; the exit status is 1 if the calibration did not pass. folds: Parquet with image_id, fold."""
    found = judge(_detections(spark, a, a.predictions), _truth(spark, a), spark.read.parquet(a.fold_table), a.thresholds, taxonomy=a.taxonomy)
    a.status = 0 if found.passed else 1
    return found.checks


@command("accept-threshold", path("predictions"), path("truth"), path("fold_table"), GRID)
def accept_threshold(spark, a):
    return _fold_verdict(spark, a, calibration.calibrate_threshold)


@command("accept-threshold-pair", path("predictions"), path("truth"), path("fold_table"), GRID)
def accept_pair(spark, a):
    return _fold_verdict(spark, a, calibration.calibrate_pair)


@command("prepare-dataset", path("images"), path("labels"), path("target"), (("--ratio",), {"type": float, "default": 0.15}), (("--seed",), {"type": int, "default": 42}), (("--reviewed",), {}), (("--duplicates",), {}))
def prepare_dataset(spark, a):
    """images: Parquet with stem, width, height, mode; labels: with stem, class_id, ord, box, difficult; reviewed: labels as well; duplicates: CSV with left, right."""
    reviewed = spark.read.parquet(a.reviewed) if a.reviewed else None
    pairs = spark.read.csv(a.duplicates, header=True) if a.duplicates else None
    made = prepare.prepare(spark.read.parquet(a.images), spark.read.parquet(a.labels), a.target, a.ratio, a.seed, reviewed, pairs, a.taxonomy)
    return made.images.groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("group_id").alias("groups"))


@command("hash-images", path("files"))
def hash_images(spark, a):
    """files: PNG files. Their hashes, or what is wrong with them."""
    return rasters.image_hashes(spark.read.format("binaryFile").load(a.files))


@command("suppress-outlines", path("detections"), (("--iou",), {"type": float, "default": 0.3}))
def suppress_outlines(spark, a):
    """detections: Parquet with image_id, class_id, ord, score, polygon."""
    return outlines.suppress_outlines(spark.read.parquet(a.detections), a.iou)


@command("check-config", path("config"))
def check_config(spark, a):
    """A pipeline's YAML, with every default filled in."""
    import json

    return spark.createDataFrame([(json.dumps(PipelineConfig.from_yaml(_text(spark, a.config)).to_dict(), sort_keys=True),)], "config string")


@command("benchmark-summary", path("samples"), (("--limit",), {"type": float, "default": 20.0}), (("--reserve",), {"type": float, "default": 1.0}))
def benchmark(spark, a):
    """samples: Parquet with stage, seconds."""
    return metrics.latency_gate(spark.read.parquet(a.samples), "seconds", a.limit, a.reserve, "stage")


@command("rates", path("counts"))
def rates(spark, a):
    """counts: Parquet with tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return spark.read.parquet(a.counts).withColumns({"recall": S.recall(tp, fn), "fdr": S.false_discovery(tp, fp), "precision": S.precision(tp, fp), "f1": S.f1(tp, fp, fn)})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="boxwright")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        for names, more in arguments:
            p.add_argument(*names, **more)
        p.add_argument("--taxonomy", choices=sorted(TAXONOMIES), default="scenes25")
        p.add_argument("--out", help="folder for JSON instead of stdout")
    a = parser.parse_args(argv)
    a.status = 0
    spark = spark or SparkSession.builder.appName("boxwright").getOrCreate()
    result = COMMANDS[a.command][0](spark, a)
    if a.out:
        result.write.mode("overwrite").json(a.out)
    else:
        for row in result.toJSON().toLocalIterator():
            print(row)
    return a.status


if __name__ == "__main__":
    sys.exit(main())
