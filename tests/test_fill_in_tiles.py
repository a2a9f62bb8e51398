"""Holes are filled where the background is told; runs stay whole."""

import helpers as H
import numpy as np
import pytest

from voxmill.functions import runs as R
from voxmill.operators import components as C
from voxmill.session import store


def _filled(mask):
    outside = H.components(~mask)
    border = np.ones(mask.shape, bool)
    border[1:-1, 1:-1, 1:-1] = False
    return mask | ~np.isin(outside, np.unique(outside[border & ~mask])) & ~mask


def _whole_runs(volumes):
    """Maximal runs of masks."""
    out = []
    for v, mask in volumes.items():
        for z, y in np.ndindex(mask.shape[:2]):
            step = np.diff(np.pad(mask[z, y].astype(int), 1))
            out += [(v, z, y, int(a), int(b) - 1) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
    return sorted(out)


@pytest.mark.parametrize("tile, dealt", [(64, 64), (8, 0), (4, 64), (3, 0), (2, 64)])
def test_filled_masks_and_whole_runs(spark, tile, dealt, monkeypatch):
    monkeypatch.setattr(C, "DEALT", dealt)
    rng = np.random.default_rng(41)
    volumes = {v: rng.random((9, 10, 13 if v else 70)) < (0.6, 0.7, 0.8, 0.85)[v] for v in range(4)}
    volumes[4] = np.zeros((4, 5, 6), bool)
    shell = np.zeros((12, 12, 20), bool)
    shell[1:11, 1:11, 1:19] = True
    shell[3:9, 3:9, 3:17] = False
    volumes |= {5: shell, 6: np.ones((1, 2, 9), bool)}
    voxels = H.voxel_table(spark, volumes).drop("value")
    want = _whole_runs({v: _filled(m) for v, m in volumes.items()})
    for mask in (store(R.from_voxels(voxels), "mask"), voxels, R.from_voxels(voxels).unionByName(R.from_voxels(voxels.filter("x < 5")))):
        found = C.fill_holes(mask, H.catalog(spark, volumes), tile).select(*R.RUN)
        assert sorted(map(tuple, found.collect())) == want


def test_runs_of_small_volumes_are_shuffled_once(spark):
    volumes = {v: np.random.default_rng(v).random((6, 7, 8)) < 0.8 for v in range(20)}
    mask = store(R.from_voxels(H.voxel_table(spark, volumes).drop("value")), "mask")
    found = C.fill_holes(mask, H.catalog(spark, volumes))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no sweep over the ends of all runs and lines
    unknown = C.fill_holes(mask, H.catalog(spark, {v: volumes[v] for v in range(5)}))
    got = {v: {tuple(r) for r in unknown.filter(f"vol_id = {v}").collect()} for v in (0, 7)}
    assert got[7] == set(_whole_runs({7: volumes[7]})) and got[0] == set(_whole_runs({0: _filled(volumes[0])}))


def test_tiles_of_a_small_volume_leave_nothing_open(spark, monkeypatch):
    monkeypatch.setattr(C, "_external", lambda *_: pytest.fail("pieces inside a block were shuffled"))
    volumes = {v: np.random.default_rng(v).random((11, 10, 13)) < 0.8 for v in range(9)}
    found = C.fill_holes(R.from_voxels(H.voxel_table(spark, volumes).drop("value")), H.catalog(spark, volumes), 4)
    assert sorted(map(tuple, found.collect())) == _whole_runs({v: _filled(m) for v, m in volumes.items()})
