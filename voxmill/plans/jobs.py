"""Whole jobs: segmentation, its classical baseline, and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bricks
from ..functions import runs as R
from ..functions.ranking import number_in_order
from ..operators import background, compare, components, distance, evaluate, features, intensity, morphology, select
from ..operators.flood import flood, peaks
from ..params import PRESETS, Flood, Preset
from ..session import lookup_join, store, union_all
from ..sources.tables import cut_crops, require_same_shape


@dataclass(frozen=True)
class Segmentation:
    """Result tables; masks, markers and labels are runs along x."""

    labels: DataFrame
    foreground: DataFrame
    markers: DataFrame
    marker_report: DataFrame | None = None


@dataclass(frozen=True)
class Evaluation:
    """Tables of the detailed evaluation."""

    best_per_true: DataFrame
    best_per_prediction: DataFrame
    summary: DataFrame
    object_recall: DataFrame


def _packed(gray: DataFrame, value: str) -> DataFrame:
    """8-bit gray voxels as stored brick rows; rows that are packed already pass."""
    return gray if "xb" in gray.columns else store(bricks.from_voxels(gray, value, "int").withColumnRenamed("v", value), "gray")


def foreground(gray: DataFrame, catalog: DataFrame, params: Flood, value: str = "gray") -> DataFrame:
    """Foreground runs of 8-bit voxels, or of brick rows with ``value``."""
    mask = intensity.foreground_mask(gray, params.threshold_offset, value)
    mask = mask if "xb" in gray.columns else R.from_voxels(mask)
    mask = morphology.close(mask, catalog, params.close_radius)
    if params.fill_holes:
        mask = components.fill_holes(mask, catalog)
    if params.min_object_size > 0:
        mask = components.drop_small(mask, params.min_object_size)
    return mask


def flood_from(
    gray: DataFrame, markers: DataFrame, catalog: DataFrame, params: Flood, value: str = "gray", dtype: str = "uint8"
) -> Segmentation:
    """Foreground, markers inside it, and the flooded labels."""
    gray = _packed(intensity.to_8bit(gray, dtype, value), value)
    mask = foreground(gray, catalog, params, value)
    if params.force_markers:
        mask = morphology.force_markers(mask, markers, catalog, params.force_radius)
    mask = store(mask, "foreground")
    inside = store(components.restrict_markers(markers, mask), "markers")
    labels = flood(distance.distance_bricks(mask, catalog), inside)
    return Segmentation(store(labels, "labels"), mask, inside)


def segment(
    gray: DataFrame, catalog: DataFrame, preset: str | Preset = "production", value: str = "gray", dtype: str = "uint8"
) -> Segmentation:
    """Flatten, find inner dark cores, refine them to markers, flood, drop small labels.

    ``dtype`` is the stored type of the gray values; all but ``uint8`` are rescaled first.
    """
    p = PRESETS[preset] if isinstance(preset, str) else preset
    gray = _packed(intensity.to_8bit(gray, dtype, value), value)
    flat = store(background.flatten_bricks(gray.withColumnRenamed(value, "v"), p.flatten), "flat")
    limits = intensity.dark_threshold(flat, p.dark, "flat")
    dark = intensity.dark_mask(flat, limits, "flat", whole=False)
    split = components.split_external(dark, catalog, p.dark.connectivity)
    cores = store(components.label(split.filter("not external").select(*R.RUN), p.markers.connectivity), "cores")
    lines = flat.select(*R.LINE, "xb", F.col("flat").alias("values"))
    judged = select.marker_features(cores, lines, catalog, p.markers, p.sampling)
    kept = select.suppress_markers(
        judged.filter("reason = 'candidate'"), p.markers.nms_min_dist, p.markers.max_markers
    )
    kept = store(kept, "kept")
    markers = store(select.survivors(cores, kept).select(*R.RUN), "markers")
    result = flood_from(gray, markers, catalog, p.flood, value)
    labels = store(components.drop_small_labels(result.labels, p.min_label_size), "labels")
    return Segmentation(labels, result.foreground, result.markers, select.marker_report(judged, kept))


def otsu_baseline(
    gray: DataFrame, catalog: DataFrame, preset: str | Preset = "production", value: str = "gray", dtype: str = "uint8"
) -> Segmentation:
    """Threshold, close, and flood from distance peaks."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    gray = _packed(intensity.to_8bit(gray, dtype, value), value)
    mask = intensity.foreground_mask(gray, p.flood.threshold_offset, value)
    mask = store(morphology.close(mask, catalog, p.flood.close_radius), "foreground")
    rows = store(distance.distance_bricks(mask, catalog), "distance")
    markers = store(peaks(rows, p.peak_min_distance), "markers")
    return Segmentation(store(flood(rows, markers), "labels"), mask, markers)


def score(
    gt: DataFrame, pred: DataFrame, catalog: DataFrame, preset: str | Preset = "production", pred_catalog: DataFrame | None = None
) -> DataFrame:
    """Threshold metrics of predicted labels against true ones, all volumes at once.

    With a catalog of the predicted volumes, shapes that differ are an error.
    """
    if pred_catalog is not None:
        require_same_shape(catalog, pred_catalog)
    p = PRESETS[preset] if isinstance(preset, str) else preset
    table = store(evaluate.contingency(evaluate.align(gt, pred), catalog), "contingency")
    return evaluate.threshold_metrics(table, p.scoring, volumes=catalog)


def detailed(
    gt: DataFrame, pred: DataFrame, catalog: DataFrame, preset: str | Preset = "production", markers: DataFrame | None = None
) -> Evaluation:
    """Best pairs, summary and recall of every listed volume; markers ``(…, label)`` are optional."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    both = evaluate.align(gt, pred)
    table = store(evaluate.contingency(both, catalog), "contingency")
    voxels = None
    if markers is not None:
        voxels = evaluate.align(gt, markers).withColumnRenamed("pred_id", "marker_id")
    best = store(evaluate.best_per_true(table, p.detail), "best")
    return Evaluation(
        best, evaluate.best_per_prediction(table, p.detail),
        evaluate.summary(table, voxels, p.detail, catalog), evaluate.object_recall(best, p.detail, catalog))


def compare_on_crops(
    gray: DataFrame, truth: DataFrame, crops: DataFrame, preset: str | Preset = "production",
    predictions: dict[str, DataFrame] | None = None, scans: DataFrame | None = None, value: str = "gray", dtype: str = "uint8",
) -> DataFrame:
    """From crops to scores: one row per scan, crop and method, as ``compare.detail`` takes them.

    Every box of ``crops`` is cut from each volume of ``gray`` (dense voxels) and ``truth`` (voxels
    with ``label``).  The threshold baseline (``otsu_ws``) and the refined markers (``refined_ws``)
    segment all crops in one job each; ``predictions`` adds methods whose labels are there already,
    voxels of the whole volumes.  Scores are those of the preset's first threshold.  ``scans`` names
    the volumes ``(vol_id, scan)``; without it a scan is called by its number.
    """
    p = PRESETS[preset] if isinstance(preset, str) else preset
    boxes = number_in_order(crops.withColumn("vol_id", F.lit(0)), [F.col("crop_id").asc()], "box").drop("vol_id")
    boxes = store(boxes, "boxes")
    n = boxes.count()

    def keyed(voxels: DataFrame) -> DataFrame:
        """The crops as volumes of their own."""
        cut = lookup_join(cut_crops(voxels, boxes.drop("box")), boxes.select("crop_id", "box"), ["crop_id"])
        key = (F.col("vol_id") * n + F.col("box") - 1).cast("int")
        return cut.withColumn("_scan", F.col("vol_id")).withColumn("vol_id", key)

    cut = store(keyed(gray.select("vol_id", "z", "y", "x", value)), "crops")
    catalog = store(cut.groupBy("vol_id", "_scan", "crop_id").agg(
        (F.max("z") + 1).alias("depth"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")), "catalog")
    shapes, voxels = catalog.drop("_scan", "crop_id"), cut.select("vol_id", "z", "y", "x", value)
    real = store(keyed(truth.select("vol_id", "z", "y", "x", "label")).select("vol_id", "z", "y", "x", "label"), "truth")
    found = {"otsu_ws": otsu_baseline(voxels, shapes, p, value, dtype).labels, "refined_ws": segment(voxels, shapes, p, value, dtype).labels}
    for method, labels in (predictions or {}).items():
        found[method] = keyed(labels.select("vol_id", "z", "y", "x", "label")).select("vol_id", "z", "y", "x", "label")
    names = catalog.select("vol_id", F.col("_scan").alias("_vol"), "crop_id")
    scans = names.select(F.col("_vol").alias("vol_id"), F.col("_vol").cast("string").alias("scan")).distinct() if scans is None else scans
    names = lookup_join(names, scans.select(F.col("vol_id").alias("_vol"), "scan"), ["_vol"])
    rows = []
    for method, labels in found.items():
        table = store(evaluate.contingency(evaluate.align(real, labels), shapes), "contingency")
        metrics = evaluate.threshold_metrics(table, p.scoring, volumes=shapes)
        named = names.select("vol_id", "scan", "crop_id", F.lit(method).alias("method"))
        rows.append(compare.crop_summary(metrics, named, p.scoring.thresholds[0]))
    return union_all(*rows)
