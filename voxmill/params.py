"""Named parameter sets for segmentation and scoring."""

from __future__ import annotations

from dataclasses import dataclass, replace

# They must equal the published configuration for equal results.
REJECT_SEED = (
    "seed_area",
    "external_background",
    "not_internal_dark",
    "center_not_dark",
    "low_ring_contrast",
    "ring_too_external",
)
REJECT_MARKER = ("area", "shape", "center", "contrast")
SEED_POINT_VALUE = 65535
SCORE_REFERENCE = 205.0
SCORE_WEIGHT = 0.02
# The order in which a report lists the four averaged metrics, then the totals.
AVERAGED_METRICS = ("precision050", "recall050", "f1050", "overseg_ratio")
TOTAL_METRICS = ("total_fp", "total_fn")


@dataclass(frozen=True)
class Flatten:
    lambda_xy: float = 15.0
    sigma_z: float = 0.0
    p_low: float = 0.5
    p_high: float = 99.5


@dataclass(frozen=True)
class Dark:
    threshold: int = -1
    percentile: float = 38.0
    otsu_offset: int = -12
    threshold_max: int = 135
    connectivity: int = 1


@dataclass(frozen=True)
class Sampling:
    center_radius: int = 2
    ring_inner: int = 4
    ring_outer: int = 10


@dataclass(frozen=True)
class SeedRules:
    area_min: int = 1
    area_max: int = 2200
    max_external_overlap: float = 0.01
    min_internal_overlap: float = 0.02
    internal_search_radius: int = 3
    center_dark_max: float = 178.0
    min_ring_contrast: float = 2.0
    max_ring_external_coverage: float = 0.40
    nms_min_dist: float = 4.0


@dataclass(frozen=True)
class MarkerRules:
    connectivity: int = 1
    area_min: int = 3
    area_max: int = 900
    max_dim: int = 30
    max_elongation: float = 8.0
    min_fill: float = 0.005
    center_dark_max: float = 205.0
    min_ring_contrast: float = -2.0
    nms_min_dist: float = 7.0
    #: Most markers per volume, 0 for all; 420 reproduces the published crops.
    max_markers: int = 0


@dataclass(frozen=True)
class Flood:
    threshold_offset: float = -10.0
    close_radius: int = 2
    fill_holes: bool = False
    force_markers: bool = False
    force_radius: int = 1
    min_object_size: int = 0


@dataclass(frozen=True)
class Scoring:
    min_gt_area: int = 1000
    ignore_gt_border: bool = False
    thresholds: tuple[float, ...] = (0.25, 0.50)


@dataclass(frozen=True)
class Preset:
    flatten: Flatten = Flatten()
    dark: Dark = Dark()
    sampling: Sampling = Sampling()
    seeds: SeedRules = SeedRules()
    markers: MarkerRules = MarkerRules()
    flood: Flood = Flood()
    min_label_size: int = 500
    peak_min_distance: int = 8
    scoring: Scoring = Scoring()
    detail: Scoring = Scoring(min_gt_area=1, thresholds=(0.10, 0.25, 0.50))


_default = Preset()
_production = Preset(
    dark=Dark(percentile=40.0, otsu_offset=-10),
    seeds=SeedRules(
        area_max=3000,
        max_external_overlap=0.10,
        min_internal_overlap=0.00,
        internal_search_radius=6,
        center_dark_max=210.0,
        min_ring_contrast=-5.0,
        max_ring_external_coverage=0.70,
        nms_min_dist=5.0,
    ),
    flood=Flood(close_radius=1, force_markers=True),
    scoring=Scoring(ignore_gt_border=True, thresholds=(0.50,)),
)

PRESETS = {
    "default": _default,
    "production": _production,
    # Production values with size limits that suit the small test volumes.
    "fixture": replace(
        _production,
        min_label_size=30,
        scoring=Scoring(min_gt_area=20, ignore_gt_border=True, thresholds=(0.50,)),
    ),
}
