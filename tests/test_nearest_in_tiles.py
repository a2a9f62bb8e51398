"""Runs meet points and tiles once: nearest mask voxels, pieces that end inside a tile, labels cut from packed lines."""

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import bricks
from voxmill.functions import runs as R
from voxmill.operators import components
from voxmill.operators import features as feat


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_nearest_meets_tiles_not_lines(spark, radius):
    rng = np.random.default_rng(5)
    masks = {1: rng.random((3, 67, 131)) < 0.02, 2: np.zeros((2, 3, 4), bool), 3: rng.random((66, 4, 5)) < 0.05}
    masks[1][:, 60:, 60:70] = False
    places = [(v, k, *(int(rng.integers(0, n)) for n in m.shape)) for v, m in masks.items() for k in range(60)]
    places += [(1, 100, 0, 0, 0), (1, 101, 2, 66, 130), (1, 102, 1, 63, 64), (1, 103, 1, 64, 63)]
    points = spark.createDataFrame(places, "vol_id int, component long, cz int, cy int, cx int")
    runs = R.from_voxels(H.voxel_table(spark, masks))
    found = feat.nearest_in_mask(points, runs, H.catalog(spark, masks), radius)
    assert "dx0" not in _plan(found)  # no row per line of the cube
    got = {(r.vol_id, r.component): (r.near_internal, r.internal_dist) for r in found.collect()}
    assert len(got) == len(places)
    for vol, component, *at in places:
        gap = np.abs(np.argwhere(masks[vol]) - np.array(at))
        d2 = (gap[(gap <= radius).all(axis=1)] ** 2).sum(axis=1)
        assert got[vol, component] == ((True, np.sqrt(d2.min())) if len(d2) else (False, np.inf))
    doubled = runs.unionByName(runs.withColumn("x1", F.col("x0")))
    again = feat.nearest_in_mask(points, doubled, H.catalog(spark, masks), radius)
    assert {(r.vol_id, r.component): (r.near_internal, r.internal_dist) for r in again.collect()} == got


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("tile", [4, 64])
def test_closed_pieces_are_judged_in_their_tile(spark, k, tile, monkeypatch):
    """Only pieces that reach another tile are merged; volumes that the catalog leaves out are judged by nothing."""
    rng = np.random.default_rng(6)
    masks = {v: rng.random(s) < 0.3 for v, s in ((1, (9, 10, 11)), (2, (4, 4, 4)), (3, (1, 1, 9)))}
    runs = R.from_voxels(H.voxel_table(spark, masks))
    seen = []
    merge = components._face_pairs
    monkeypatch.setattr(components, "_face_pairs", lambda opened, *rest: seen.append(opened.count()) or merge(opened, *rest))
    split = components.split_external(runs, H.catalog(spark, {v: masks[v] for v in (1, 2)}), k, tile)
    got = {(r.vol_id, r.z, r.y, r.x): r.external for r in R.to_voxels(split).collect()}
    want = {}
    for v in (1, 2):
        found = H.components(masks[v], k)
        for n in range(1, found.max() + 1):
            places = np.argwhere(found == n)
            face = bool(((places == 0) | (places == np.array(masks[v].shape) - 1)).any())
            want.update({(v, *map(int, p)): face for p in places})
    assert got == want
    assert not seen if tile == 64 else seen and 0 < seen[0] < runs.count() + len(want)


def test_labels_are_cut_from_packed_lines(spark):
    """As the runs of voxel rows, but for borders of bricks."""
    labels = {1: np.random.default_rng(7).integers(0, 3, (2, 3, 130)), 2: np.zeros((1, 2, 3), int)}
    voxels = H.voxel_table(spark, labels, "component", keep_zero=True)
    rows = bricks.from_voxels(voxels, "component", "int")
    want = {tuple(r) for r in R.blocks(R.from_voxels(voxels.filter("component > 0"), ("component",))).select(*R.RUN, "component").collect()}
    got = bricks.label_runs(rows, "v", "component")
    assert {tuple(r) for r in got.collect()} == want
