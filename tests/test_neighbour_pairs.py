"""Neighbouring voxels are counted in tiles, and each run is shuffled once."""

import helpers as H
import numpy as np
import pytest

from voxmill.functions import offsets
from voxmill.functions import runs as R
from voxmill.operators import components as C
from voxmill.session import store


@pytest.mark.parametrize("tile", [64, 4])
def test_pairs_equal_moved_masks(spark, tile):
    rng = np.random.default_rng(31)
    volumes = {1: rng.random((5, 9, 70)) < 0.5, 2: rng.random((9, 4, 6)) < 0.6, 3: np.zeros((3, 3, 3), bool), 4: np.ones((1, 1, 1), bool)}
    mask = store(R.from_voxels(H.voxel_table(spark, volumes).drop("value")), "mask")
    cat = H.catalog(spark, volumes)
    steps = {k: offsets.neighbour_steps(k) for k in (1, 2, 3)}
    found = C.neighbour_pairs(mask, cat, steps, tile)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2  # runs to tiles, counts to volumes
    got = {(r.vol_id, r.k): r.pairs for r in found.collect()}
    want = {}
    for k in (1, 2, 3):
        moved = R.overlap(R.shift(mask, cat, steps[k], grow=True), mask).groupBy("vol_id").agg({"*": "count"}).collect()
        for v in {r.vol_id for r in moved}:
            wide = np.pad(volumes[v], 1)
            here = np.argwhere(wide)
            want[v, k] = sum(int(wide[tuple(p + s)]) for p in here for s in H.steps(k))
    assert got == want and (3, 3) not in got and (4, 3) not in got
    half = H.catalog(spark, {2: volumes[2][:, :, :3]})
    few = C.neighbour_pairs(mask, half, {1: [(0, 0, 1, 1)]}, tile).collect()
    assert [(r.vol_id, r.pairs) for r in few] == [(2, int((volumes[2][:, :, :2] & volumes[2][:, :, 1:3]).sum()))]
