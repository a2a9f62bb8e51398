"""Scoring predicted instances against true ones.

``contingency`` reduces the voxels once, with partial aggregates before the
shuffle, to counts per (true, predicted) id pair.  Every score below is derived
from that small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import session
from ..functions import runs as R
from ..params import Scoring
from ..session import by_block, is_small, lookup_join, union_all
from .components import on_border
from .matching import optimal_matching


def _label_runs(labels: DataFrame, name: str) -> DataFrame:
    if "x0" in labels.columns:
        return labels.filter("label > 0").select(*R.RUN, F.col("label").alias(name))
    line = W.partitionBy(*R.LINE).orderBy("x")
    goes_on = (F.lag("x").over(line) + 1 == F.col("x")) & (F.lag("label").over(line) == F.col("label"))
    opens = labels.filter("label > 0").withColumn("_opens", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_opens").over(line))
    return opens.groupBy(*R.LINE, "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("label").alias(name)).drop("_run")


def align(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Stretches ``(vol_id, z, y, x0, x1, gt_id, pred_id)`` of two label tables, 0 for background.

    The tables are voxels ``(…, x, label)`` or runs ``(…, x0, x1, label)``.  One sweep along
    each line passes the ends of both tables' runs and carries the two labels at hand, so
    rows grow with runs, not with voxels.
    """
    marks = []
    for labels, name, other in ((gt, "gt_id", "pred_id"), (pred, "pred_id", "gt_id")):
        runs = _label_runs(labels, name)
        v = F.col(name)
        kind = runs.schema[name].dataType
        # The line travels in the struct: the two tables' partitions need not agree, so the union must not pass for partitioned.
        ends = F.explode(F.array(
            F.struct("z", "y", F.col("x0").alias("x"), v.alias("v")),
            F.struct("z", "y", (F.col("x1") + 1).alias("x"), F.lit(0).cast(kind).alias("v")))).alias("e")
        marks.append(runs.select("vol_id", ends).select("vol_id", "e.z", "e.y", "e.x", F.col("e.v").alias(name), F.lit(None).cast(kind).alias(other)))
    line = W.partitionBy(*R.LINE).orderBy("x")
    # Where one run ends and the next begins, the label above zero counts.
    at = by_block(union_all(*marks), *R.LINE).groupBy(*R.LINE, "x").agg(F.max("gt_id").alias("gt_id"), F.max("pred_id").alias("pred_id"))
    held = {c: F.coalesce(F.last(c, ignorenulls=True).over(line), F.lit(0)) for c in ("gt_id", "pred_id")}
    swept = at.withColumns({"x1": F.lead("x").over(line) - 1, **held}).filter("gt_id > 0 or pred_id > 0")
    return swept.select(*R.LINE, F.col("x").alias("x0"), "x1", "gt_id", "pred_id")


def _size(rows: DataFrame) -> Column:
    """Voxels of a row: a voxel, or a stretch of a line."""
    return R.length() if "x0" in rows.columns else F.lit(1).cast("long")


def _in_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Voxels ``(vol_id, gt_id, pred_id, z, y, x)`` counted per batch, volume, pair of labels and place.

    A voxel lies on a lower face (``low``), or possibly on the upper one of an axis: only those
    farthest out in their batch and volume can, so one coordinate (else null) tells of all of them.
    """
    for batch in batches:
        if not len(batch):
            continue
        codes = [batch.column(k).dictionary_encode("encode") for k in range(3)]
        vol, gt, pred = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes)
        at = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4, 5)]
        low = np.logical_or.reduce([c == 0 for c in at])
        key = (vol * len(codes[1].dictionary) + gt) * len(codes[2].dictionary) + pred
        key = key * 2 + low
        for c in at:
            farthest = np.full(len(codes[0].dictionary), -1, np.int64)
            np.maximum.at(farthest, vol, c)
            key = key * 2 + (~low & (c == farthest[vol]))
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        row = pa.array(first)
        upper = [pa.array(c[first].astype(np.int32), mask=(key >> shift & 1) == 0) for c, shift in zip(at, (2, 1, 0))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(row) for k in range(3)), pa.array(low[first]), *upper, pa.array(n.astype(np.int64))],
            ["vol_id", "gt_id", "pred_id", "low", "uz", "uy", "ux", "n"])


def contingency(labelled: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(vol_id, gt_id, pred_id, n, border)``; ``border``: voxels on a face.

    ``labelled`` are voxels or the stretches of ``align``.  A catalog too large to be
    broadcast meets counts made by the tasks that read the voxels, so no voxel is shuffled; results are the same.
    """
    some = labelled.filter("gt_id > 0 or pred_id > 0")
    ids = ["vol_id", "gt_id", "pred_id"]
    if "x0" in labelled.columns:
        sized = lookup_join(some.select(*R.RUN, "gt_id", "pred_id"), catalog, ["vol_id"])
        face = (F.col("z") == 0) | (F.col("z") == F.col("depth") - 1) | (F.col("y") == 0) | (F.col("y") == F.col("height") - 1)
        ends = (F.col("x0") == 0).cast("long") + (F.col("x1") == F.col("width") - 1).cast("long")
        touches = F.when(face, R.length()).otherwise(F.least(ends, R.length()))
        return sized.groupBy(*ids).agg(F.sum(R.length()).alias("n"), F.sum(touches).alias("border"))
    if is_small(catalog, session.BROADCAST_ROWS):
        sized = lookup_join(some.select(*ids, "z", "y", "x"), catalog, ["vol_id"])
        return sized.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.sum(on_border(x0="x", x1="x").cast("long")).alias("border"))
    types = {c: some.schema[c].dataType.simpleString() for c in ids}
    kept = ", ".join(f"{c} {t}" for c, t in types.items())
    rows = some.filter("vol_id is not null").select(*ids, *(F.col(c).cast("int").alias(c) for c in ("z", "y", "x")))
    counted = rows.mapInArrow(_in_tallies, f"{kept}, low boolean, uz int, uy int, ux int, n long")
    counted = counted.groupBy(*ids, "low", "uz", "uy", "ux").agg(F.sum("n").alias("n"))
    upper = [F.coalesce(F.col("u" + c) == F.col(side) - 1, F.lit(False)) for c, side in (("z", "depth"), ("y", "height"), ("x", "width"))]
    face = F.col("low") | upper[0] | upper[1] | upper[2]
    return lookup_join(counted, catalog, ["vol_id"]).groupBy(*ids).agg(
        F.sum("n").alias("n"), F.sum(F.when(face, F.col("n")).otherwise(0)).alias("border"))


def label_sizes(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.filter(F.col(label) > 0).groupBy("vol_id", label).agg(F.count(F.lit(1)).alias("voxels"))


def border_labels(voxels: DataFrame, catalog: DataFrame, label: str = "label") -> DataFrame:
    touching = voxels.filter(F.col(label) > 0).select("vol_id", "z", "y", "x", label)
    return lookup_join(touching, catalog, ["vol_id"]).filter(on_border(x0="x", x1="x")).select(
        "vol_id", label
    ).distinct()


def true_instances(table: DataFrame, scoring: Scoring) -> DataFrame:
    """``(vol_id, gt_id, gt_voxels, on_border, valid)`` of every true instance."""
    sizes = table.filter("gt_id > 0").groupBy("vol_id", "gt_id").agg(
        F.sum("n").alias("gt_voxels"), (F.sum("border") > 0).alias("on_border")
    )
    valid = F.col("gt_voxels") >= scoring.min_gt_area
    if scoring.ignore_gt_border:
        valid = valid & ~F.col("on_border")
    return sizes.withColumn("valid", valid)


def predicted_instances(table: DataFrame) -> DataFrame:
    return table.filter("pred_id > 0").groupBy("vol_id", "pred_id").agg(F.sum("n").alias("pred_voxels"))


def intersections(table: DataFrame) -> DataFrame:
    return table.filter("gt_id > 0 and pred_id > 0").select(
        "vol_id", "gt_id", "pred_id", F.col("n").alias("intersection_voxels")
    )


def valid_intersections(table: DataFrame, gts: DataFrame) -> DataFrame:
    """Pairs with valid true instances; all pairs in a volume without any."""
    volumes = gts.groupBy("vol_id").agg(F.max("valid").alias("_any"))
    pairs = lookup_join(intersections(table), volumes, ["vol_id"])
    flags = gts.select("vol_id", "gt_id", "valid")
    return pairs.join(flags, ["vol_id", "gt_id"]).filter("valid or not _any").select(
        "vol_id", "gt_id", "pred_id", "intersection_voxels"
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def with_overlap_scores(pairs: DataFrame, gts: DataFrame, preds: DataFrame) -> DataFrame:
    """Add sizes, ``iou`` and ``dice`` to intersecting pairs."""
    both = pairs.join(gts.select("vol_id", "gt_id", "gt_voxels", "valid"), ["vol_id", "gt_id"]).join(
        preds, ["vol_id", "pred_id"]
    )
    shared, total = F.col("intersection_voxels"), F.col("gt_voxels") + F.col("pred_voxels")
    return both.withColumn("iou", _ratio(shared, total - shared)).withColumn("dice", _ratio(2 * shared, total))


def judged_predictions(table: DataFrame, gts: DataFrame) -> DataFrame:
    """Predictions with ``evaluable``: not mostly over ignored true instances."""
    pairs = intersections(table).join(gts.select("vol_id", "gt_id", "valid"), ["vol_id", "gt_id"])
    covered = pairs.groupBy("vol_id", "pred_id").agg(
        F.sum(F.when(F.col("valid"), F.col("intersection_voxels")).otherwise(0)).alias("valid_overlap"),
        F.sum(F.when(~F.col("valid"), F.col("intersection_voxels")).otherwise(0)).alias("ignored_overlap"),
    )
    joined = predicted_instances(table).join(covered, ["vol_id", "pred_id"], "left")
    joined = joined.fillna(0, ["valid_overlap", "ignored_overlap"])
    return joined.withColumn("evaluable", F.col("ignored_overlap") <= F.col("valid_overlap"))


def matching(table: DataFrame, scoring: Scoring) -> DataFrame:
    """Optimal one-to-one pairs of valid true and evaluable predicted instances."""
    gts = true_instances(table, scoring)
    preds = judged_predictions(table, gts)
    pairs = with_overlap_scores(intersections(table), gts.filter("valid"), predicted_instances(table))
    pairs = pairs.join(preds.filter("evaluable").select("vol_id", "pred_id"), ["vol_id", "pred_id"], "left_semi")
    return optimal_matching(pairs)


def _thresholds(scoring: Scoring) -> Column:
    if min(scoring.thresholds) <= 0:
        raise ValueError("IoU thresholds must be positive")
    return F.explode(F.array(*[F.lit(float(t)) for t in scoring.thresholds]))


def matches(matched: DataFrame, scoring: Scoring) -> DataFrame:
    """``(vol_id, threshold, gt_id, pred_id, iou)`` of matched pairs per threshold."""
    rows = matched.withColumn("threshold", _thresholds(scoring)).filter("iou >= threshold")
    return rows.select("vol_id", "threshold", "gt_id", "pred_id", "iou")


def _of_all(volumes: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows``, plus a row of zeros for each listed volume that has none."""
    if volumes is None:
        return rows
    return volumes.select("vol_id").distinct().join(rows, "vol_id", "left").fillna(0)


def threshold_metrics(
    table: DataFrame, scoring: Scoring, matched: DataFrame | None = None, volumes: DataFrame | None = None
) -> DataFrame:
    """One row per volume and threshold.

    Volumes without any label only have rows if ``volumes`` (a catalog) lists them;
    the same holds for the other scores below.
    """
    if matched is None:
        matched = matching(table, scoring)
    gts = true_instances(table, scoring)
    true_counts = gts.groupBy("vol_id").agg(F.sum(F.col("valid").cast("long")).alias("gt_valid"))
    pred_counts = judged_predictions(table, gts).groupBy("vol_id").agg(
        F.count(F.lit(1)).alias("pred_total"), F.sum(F.col("evaluable").cast("long")).alias("pred_eval")
    )
    hits = matches(matched, scoring).groupBy("vol_id", "threshold").agg(F.count(F.lit(1)).alias("tp"))
    rows = _of_all(volumes, true_counts.join(pred_counts, "vol_id", "full").fillna(0))
    rows = rows.withColumn("threshold", _thresholds(scoring))
    rows = rows.join(hits, ["vol_id", "threshold"], "left").fillna(0, ["tp"])
    rows = rows.withColumn("fp", F.col("pred_eval") - F.col("tp")).withColumn("fn", F.col("gt_valid") - F.col("tp"))
    rows = rows.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    rows = rows.withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return rows.select(
        "vol_id", "threshold", "gt_valid", "pred_total", "pred_eval",
        (F.col("pred_total") - F.col("pred_eval")).alias("pred_ignored_border"),
        "tp", "fp", "fn", "precision", "recall",
        _ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"),
        _ratio(F.col("pred_eval"), F.col("gt_valid")).alias("overseg_ratio_pred_eval_gt"),
    )


def foreground_overlap(table: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """Voxel counts and IoU, Dice, precision, recall of the two foregrounds."""
    def voxels(condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), F.col("n")).otherwise(0))

    counts = table.groupBy("vol_id").agg(
        voxels("gt_id > 0").alias("foreground_gt_voxels"),
        voxels("pred_id > 0").alias("foreground_pred_voxels"),
        voxels("gt_id > 0 and pred_id > 0").alias("foreground_intersection"),
    )
    counts = _of_all(volumes, counts)
    gt, pred = F.col("foreground_gt_voxels"), F.col("foreground_pred_voxels")
    both = F.col("foreground_intersection")
    return counts.select(
        "*",
        _ratio(both, gt + pred - both).alias("foreground_iou"),
        _ratio(2 * both, gt + pred).alias("foreground_dice"),
        _ratio(both, pred).alias("foreground_precision"),
        _ratio(both, gt).alias("foreground_recall"),
    )


def _best(pairs: DataFrame, side: str, other: str) -> DataFrame:
    """Per ``side`` the pair of largest IoU, ties to the smallest other id."""
    fields = ["iou", "dice", "intersection_voxels", other, "gt_voxels", "pred_voxels"]
    top = F.max(F.struct(F.col("iou").alias("_i"), (-F.col(other)).alias("_o"), *[F.col(f).alias("_" + f) for f in fields]))
    best = pairs.groupBy("vol_id", side).agg(top.alias("t"), F.count(F.lit(1)).alias("touching"))
    return best.select("vol_id", side, "touching", *[F.col(f"t._{f}").alias(f) for f in fields])


def best_per_true(table: DataFrame, scoring: Scoring) -> DataFrame:
    """Best prediction of every valid true instance, or ``missed``."""
    gts = true_instances(table, scoring)
    pairs = with_overlap_scores(intersections(table), gts.filter("valid"), predicted_instances(table))
    best = _best(pairs, "gt_id", "pred_id").drop("gt_voxels")
    rows = gts.filter("valid").select("vol_id", "gt_id", "gt_voxels").join(best, ["vol_id", "gt_id"], "left")
    status = F.when(F.col("pred_id").isNull(), "missed").otherwise("matched")
    rows = rows.withColumn("status", status)
    return rows.fillna(0).select(
        "vol_id", "gt_id", "gt_voxels", F.col("pred_id").alias("best_pred_id"), "pred_voxels",
        F.col("intersection_voxels").alias("intersection"), "iou", "dice",
        F.col("touching").alias("num_pred_touching_gt"), "status",
    )


def best_per_prediction(table: DataFrame, scoring: Scoring) -> DataFrame:
    """Best valid true instance of every prediction, with its merge status."""
    gts = true_instances(table, scoring)
    preds = predicted_instances(table)
    kept = valid_intersections(table, gts)
    touched = kept.select("vol_id", "pred_id").distinct().withColumn("_touched", F.lit(True))
    pairs = with_overlap_scores(kept, gts, preds).filter("valid")
    best = _best(pairs, "pred_id", "gt_id").drop("pred_voxels")
    rows = preds.join(touched, ["vol_id", "pred_id"], "left").join(best, ["vol_id", "pred_id"], "left")
    status = (
        F.when(F.col("_touched").isNull(), "background_or_unmatched")
        .when(F.col("gt_id").isNull(), "no_valid_gt")
        .when(F.col("touching") > 1, "merge_candidate")
        .otherwise("matched_candidate")
    )
    return rows.withColumn("status", status).fillna(0).select(
        "vol_id", "pred_id", "pred_voxels", F.col("gt_id").alias("best_gt_id"), "gt_voxels",
        F.col("intersection_voxels").alias("intersection"), "iou", "dice",
        F.col("touching").alias("num_gt_touching_pred"), "status",
    )


def marker_overlap(voxels: DataFrame) -> DataFrame:
    """Per marker its size and the true instance it covers most."""
    counts = voxels.filter("marker_id > 0").groupBy("vol_id", "marker_id", "gt_id").agg(F.sum(_size(voxels)).alias("n"))
    top = F.max(F.when(F.col("gt_id") > 0, F.struct(F.col("n"), (-F.col("gt_id")).alias("o"))))
    rows = counts.groupBy("vol_id", "marker_id").agg(F.sum("n").alias("marker_voxels"), top.alias("t"))
    return rows.select(
        "vol_id", "marker_id", "marker_voxels",
        F.coalesce(-F.col("t.o"), F.lit(0)).alias("dominant_gt_id"),
        F.coalesce(F.col("t.n"), F.lit(0)).alias("overlap_voxels"),
        F.when(F.col("t").isNull(), "background").otherwise("inside_gt").alias("status"),
    )


def marker_tallies(voxels: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """Number of markers and their voxels on and off true instances."""
    counts = voxels.filter("marker_id > 0").groupBy("vol_id", "marker_id").agg(
        F.sum(F.when(F.col("gt_id") > 0, _size(voxels)).otherwise(0)).alias("on"), F.sum(F.when(F.col("gt_id") == 0, _size(voxels)).otherwise(0)).alias("off")
    )
    return _of_all(volumes, counts.groupBy("vol_id").agg(
        F.count(F.lit(1)).alias("marker_components"),
        F.sum("on").alias("marker_voxels_on_gt"),
        F.sum("off").alias("marker_voxels_on_background"),
    ))


def object_recall(best: DataFrame, scoring: Scoring, volumes: DataFrame | None = None) -> DataFrame:
    """Valid true instances whose best IoU reaches each threshold; 0 where there are none."""
    rows = best.select("vol_id", "status", "iou")
    if volumes is not None:
        rows = volumes.select("vol_id").distinct().join(rows, "vol_id", "left")
    rows = rows.withColumn("threshold", _thresholds(scoring))
    hit = F.coalesce((F.col("status") == "matched") & (F.col("iou") >= F.col("threshold")), F.lit(False)).cast("long")
    return rows.groupBy("vol_id", "threshold").agg(
        F.avg(hit).alias("gt_object_recall"), F.sum(hit).alias("gt_matched_count")
    )


def summary(table: DataFrame, voxels: DataFrame | None, scoring: Scoring, volumes: DataFrame | None = None) -> DataFrame:
    """Long ``(vol_id, position, metric, value)`` table in report order."""
    gts = true_instances(table, scoring)
    border = F.sum(F.col("on_border").cast("long")) if scoring.ignore_gt_border else F.lit(0).cast("long")
    base = (
        gts.groupBy("vol_id")
        .agg(
            F.count(F.lit(1)).alias("gt_total_ids_touching_crop"),
            F.sum(F.col("valid").cast("long")).alias("gt_valid_ids_after_filter"),
            border.alias("gt_border_ids_ignored_if_enabled"),
        )
        .join(predicted_instances(table).groupBy("vol_id").agg(F.count(F.lit(1)).alias("pred_label_count")), "vol_id", "full")
        .join(foreground_overlap(table, volumes), "vol_id", "full")
        .withColumn("gt_min_area_filter", F.lit(scoring.min_gt_area))
        .withColumn("ignore_gt_border", F.lit(int(scoring.ignore_gt_border)))
    )
    names = [
        "gt_total_ids_touching_crop", "gt_valid_ids_after_filter", "gt_border_ids_ignored_if_enabled",
        "gt_min_area_filter", "ignore_gt_border", "pred_label_count", "foreground_gt_voxels",
        "foreground_pred_voxels", "foreground_intersection", "foreground_iou", "foreground_dice",
        "foreground_precision", "foreground_recall", "marker_components",
    ]
    if voxels is not None:
        base = base.join(marker_tallies(voxels, volumes), "vol_id", "left")
        names += ["marker_voxels_on_gt", "marker_voxels_on_background"]
    else:
        base = base.withColumn("marker_components", F.lit(0))
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("metric"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value"))
        for i, n in enumerate(names)
    ]
    fixed = base.select("vol_id", F.explode(F.array(*entries)).alias("e")).select("vol_id", "e.*")
    recall = object_recall(best_per_true(table, scoring), scoring, volumes)
    order = {float(t): i for i, t in enumerate(scoring.thresholds)}
    at = F.lit(len(names)).cast("int")
    for t, i in order.items():
        at = F.when(F.col("threshold") == t, F.lit(len(names) + 2 * i)).otherwise(at)
    tag = F.col("threshold").cast("string")
    pair = F.array(
        F.struct(at.alias("position"), F.concat(F.lit("gt_object_recall_iou_"), tag).alias("metric"),
                 F.col("gt_object_recall").alias("value")),
        F.struct((at + 1).alias("position"), F.concat(F.lit("gt_matched_count_iou_"), tag).alias("metric"),
                 F.col("gt_matched_count").cast("double").alias("value")),
    )
    return union_all(fixed, recall.select("vol_id", F.explode(pair).alias("e")).select("vol_id", "e.*"))


def label_count(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Shape, range and number of ids above zero of dense label volumes."""
    by_value = voxels.groupBy("vol_id", F.col(label).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.max("z").alias("z"), F.max("y").alias("y"), F.max("x").alias("x")
    )
    return by_value.groupBy("vol_id").agg(
        (F.max("z") + 1).alias("depth"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.sum((F.col("v") > 0).cast("long")).alias("labels"),
    )


def component_areas(labelled: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """Number of components and their smallest, mean and largest area."""
    areas = labelled.groupBy("vol_id", "component").agg(F.sum(R.length()).alias("area"))
    return _of_all(volumes, areas.groupBy("vol_id").agg(
        F.count(F.lit(1)).alias("components"), F.min("area").alias("area_min"),
        F.avg("area").alias("area_mean"), F.max("area").alias("area_max"),
    ))
