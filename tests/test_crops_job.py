"""The job from crops to scores."""

from itertools import product

import numpy as np

import helpers as H
from voxmill.operators import compare
from voxmill.params import PRESETS
from voxmill.plans import jobs


def test_crops_are_segmented_and_scored_for_every_method(spark):
    rng = np.random.default_rng(3)
    shape = (20, 22, 26)
    gray, truth = rng.integers(25, 45, shape), np.zeros(shape, int)
    grid = np.indices(shape)
    for k, centre in enumerate(product((5, 14), (5, 15), (6, 18)), 1):
        d2 = sum((g - c) ** 2 for g, c in zip(grid, centre))
        gray[d2 <= 16] = 180 + k
        gray[d2 <= 2] = 30
        truth[d2 <= 16] = k
    pred = np.where(truth % 3 == 0, 0, truth)
    gray_rows = H.voxel_table(spark, {4: gray}, "gray", keep_zero=True)
    labels = {name: H.voxel_table(spark, {4: a}, "label") for name, a in (("truth", truth), ("pred", pred))}
    boxes = spark.createDataFrame([("all", 0, 0, 0, 40), ("part", 1, 0, 2, 18)], "crop_id string, x int, y int, z int, size int")
    scans = spark.createDataFrame([(4, "scan_a")], "vol_id int, scan string")
    rows = jobs.compare_on_crops(gray_rows, labels["truth"], boxes, "fixture", {"mintree_ws": labels["pred"]}, scans)
    got = {(r.crop_id, r.method): r for r in rows.collect()}
    assert set(got) == set(product(("all", "part"), ("otsu_ws", "refined_ws", "mintree_ws"))) and {r.scan for r in got.values()} == {"scan_a"}
    p = PRESETS["fixture"].scoring
    for crop, (z, y, x) in (("all", (slice(None),) * 3), ("part", (slice(2, 20), slice(0, 18), slice(1, 19)))):
        a, b = ({1: v[z, y, x]} for v in (truth, pred))
        want = jobs.score(H.voxel_table(spark, a, "label"), H.voxel_table(spark, b, "label"), H.catalog(spark, a), "fixture").filter(f"threshold = {p.thresholds[0]}").first()
        row = got[crop, "mintree_ws"]
        assert (row.gt_valid, row.pred_labels, row.pred_eval, row.fp050, row.fn050) == (want.gt_valid, want.pred_total, want.pred_eval, want.fp, want.fn)
        assert row.precision050 == want.precision and row.recall050 == want.recall
    assert got["all", "otsu_ws"].gt_valid == got["all", "mintree_ws"].gt_valid == 8
    assert got["all", "otsu_ws"].pred_labels > 0
    assert set(compare.DETAIL) <= set(rows.columns)
