"""Typed configurations from YAML: every field is checked, and an unknown one is an error."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from boxwright.operators import inference
from boxwright.sources.readers import yaml_config
from boxwright.taxonomy import TAXONOMIES


def _classes(taxonomy: str) -> set[int]:
    return {c for _, low, high in TAXONOMIES[taxonomy] for c in range(low, high + 1)}


def _share(value: object, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError(f"{name} must lie in 0 .. 1")
    return float(value)


def _rules(given: object, wanted: tuple[str, ...], name: str) -> dict[int, dict]:
    if not isinstance(given, Mapping) or any(not isinstance(r, Mapping) or set(r) != set(wanted) for r in given.values()):
        raise ValueError(f"{name} must map classes to {', '.join(wanted)}")
    return {int(c): dict(r) for c, r in given.items()}


@dataclass(frozen=True)
class PipelineConfig:
    """What run_pipeline needs. Thresholds for exactly the taxonomy's classes; suppression (method iou or diou, threshold) and
    low-score area rules (score_ceiling, min_area) for any of them."""

    class_thresholds: dict[int, float]
    task: str = "obb"
    taxonomy: str = "scenes25"
    image_size: int = 1024
    tile_size: int = 1024
    overlap: float = 0.2
    batch_size: int = 8
    merge_iou: float = 0.3
    edge_margin: int = 16
    class_suppression: dict[int, dict] = field(default_factory=dict)
    class_low_score_area_filters: dict[int, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.taxonomy not in TAXONOMIES or self.task not in ("detect", "obb"):
            raise ValueError("unknown taxonomy or task")
        for name in ("image_size", "tile_size", "batch_size"):
            if isinstance(getattr(self, name), bool) or not isinstance(getattr(self, name), int) or getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a positive whole number")
        if not 0 <= self.overlap < 1 or self.edge_margin < 0:
            raise ValueError("overlap must lie in [0, 1) and edge_margin be no less than 0")
        _share(self.merge_iou, "merge_iou")
        known = _classes(self.taxonomy)
        if set(self.class_thresholds) != known:
            raise ValueError("class_thresholds must name exactly the taxonomy's classes")
        for c, t in self.class_thresholds.items():
            _share(t, f"threshold of class {c}")
        for name in ("class_suppression", "class_low_score_area_filters"):
            if set(getattr(self, name)) - known:
                raise ValueError(f"{name} names classes outside the taxonomy")
        for c, r in self.class_suppression.items():
            if r["method"] not in ("iou", "diou"):
                raise ValueError(f"suppression of class {c} must be by iou or diou")
            _share(r["threshold"], f"suppression of class {c}")
        for c, r in self.class_low_score_area_filters.items():
            _share(r["score_ceiling"], f"score ceiling of class {c}")
            if r["min_area"] < 0:
                raise ValueError(f"min_area of class {c} must be no less than 0")

    @classmethod
    def from_yaml(cls, text: str) -> PipelineConfig:
        raw = yaml_config(text, {f.name for f in fields(cls)} | {"model_path", "device", "half"})
        for name in ("model_path", "device", "half"):  # the detector's own
            raw.pop(name, None)
        if not isinstance(raw.get("class_thresholds"), Mapping):
            raise ValueError("class_thresholds must be a mapping")
        raw["class_thresholds"] = {int(c): t for c, t in raw["class_thresholds"].items()}
        raw["class_suppression"] = _rules(raw.get("class_suppression", {}), ("method", "threshold"), "class_suppression")
        raw["class_low_score_area_filters"] = _rules(raw.get("class_low_score_area_filters", {}), ("score_ceiling", "min_area"), "class_low_score_area_filters")
        return cls(**raw)

    def to_dict(self) -> dict:
        return asdict(self)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Thresholds, suppression and area rules as tables of a row a class."""
        t = spark.createDataFrame([(c, float(v)) for c, v in sorted(self.class_thresholds.items())], "class_id int, threshold double")
        s = [(c, r["method"], float(r["threshold"])) for c, r in sorted(self.class_suppression.items())]
        a = [(c, float(r["score_ceiling"]), float(r["min_area"])) for c, r in sorted(self.class_low_score_area_filters.items())]
        return (
            t,
            spark.createDataFrame(s, "class_id int, method string, threshold double") if s else None,
            spark.createDataFrame(a, "class_id int, min_score double, min_area double") if a else None,
        )

    def run(self, images: DataFrame, detector) -> DataFrame:
        thresholds, rules, areas = self.tables(images.sparkSession)
        return inference.run_pipeline(images, detector, thresholds, self.tile_size, self.overlap, float(self.edge_margin), self.merge_iou, rules, areas)


@dataclass(frozen=True)
class MultiscalePolicy:
    """How detections of three scales are fused."""

    class_thresholds: dict[int, float]
    aircraft_supplement_threshold: float
    aircraft_duplicate_iou: float
    ship_supplement_threshold: float
    ship_duplicate_iou: float
    vehicle_score_ceiling: float
    vehicle_min_area: float
    taxonomy: str = "scenes25"

    def __post_init__(self) -> None:
        if set(self.class_thresholds) != _classes(self.taxonomy):
            raise ValueError("class_thresholds must name exactly the taxonomy's classes")
        for c, t in self.class_thresholds.items():
            _share(t, f"threshold of class {c}")
        for f in fields(self)[1:6]:
            _share(getattr(self, f.name), f.name)
        if not self.vehicle_min_area >= 0:
            raise ValueError("vehicle_min_area must be no less than 0")

    @classmethod
    def from_yaml(cls, text: str) -> MultiscalePolicy:
        raw = yaml_config(text, {f.name for f in fields(cls)})
        missing = {f.name for f in fields(cls)[:-1]} - set(raw)
        if missing or not isinstance(raw["class_thresholds"], Mapping):
            raise ValueError(f"missing or malformed: {sorted(missing) or 'class_thresholds'}")
        raw["class_thresholds"] = {int(c): t for c, t in raw["class_thresholds"].items()}
        return cls(**raw)

    def pair(self, coarse: str) -> tuple[float, float]:
        return float(getattr(self, f"{coarse}_supplement_threshold")), float(getattr(self, f"{coarse}_duplicate_iou"))
