"""Runs are cut before the shuffle; morphology and labelling meet at the faces of tiles."""

import helpers as H
import numpy as np
import pyarrow as pa
import pytest

from voxmill.functions import runs as R
from voxmill.functions import tiles
from voxmill.operators import components as C
from voxmill.operators import morphology as M


@pytest.fixture(scope="module")
def wide():
    """Past one tile along z and y, and past one painted stretch along x."""
    rng = np.random.default_rng(5)
    mask = rng.random((66, 66, 11)) < 0.02
    mask[60:66, 62:66, :] |= rng.random((6, 4, 11)) < 0.5
    return mask


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_cut_in_the_task_that_reads(spark, wide):
    voxels = H.voxel_table(spark, {1: wide}).drop("value")
    plan = _plan(R.from_voxels(voxels))
    assert plan.rindex("MapInArrow") > plan.rindex("Exchange")  # below it
    shuffled = voxels.repartition(5)
    got = {tuple(r) for r in R.from_voxels(shuffled).collect()}
    assert got == {tuple(r) for r in R.from_voxels(voxels).collect()}
    assert sum(x1 - x0 + 1 for *_, x0, x1 in got) == wide.sum()


@pytest.mark.parametrize("radius", [1, 2])
def test_morphology_across_tiles_and_stretches(spark, wide, radius, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 8, raising=False)
    runs, cat = R.from_voxels(H.voxel_table(spark, {1: wide}).drop("value")), H.catalog(spark, {1: wide})
    grown = H.dilate(wide, radius)
    assert (H.mask_arrays(M.dilate(runs, cat, radius), {1: wide})[1] == grown).all()
    assert (H.mask_arrays(M.erode(runs, cat, radius), {1: wide})[1] == H.erode(wide, radius)).all()
    closed = M.close(runs, cat, radius)
    assert (H.mask_arrays(closed, {1: wide})[1] == H.erode(grown, radius)).all()
    rows = closed.collect()
    assert not {(r.z, r.y, r.x1 + 1) for r in rows} & {(r.z, r.y, r.x0) for r in rows}
    assert "Window" not in _plan(closed).split("MapInArrow")[0]  # no sweep over copies for every line of the ball


def test_whole_groups_are_not_split():
    batches = [pa.record_batch({"k": [a] * n}) for a, n in ((1, 3), (1, 2), (2, 1), (3, 9), (3, 1), (4, 1))]
    found = [t.column(0).to_pylist() for t in tiles.whole_groups(iter(batches), 1, rows=4)]
    assert sum(found, []) == [1] * 5 + [2] + [3] * 10 + [4]
    assert all(a[-1] < b[0] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_many_tiles_in_one_call(spark, k):
    rng = np.random.default_rng(k)
    volumes = {v: rng.random((9, 10, 11)) < 0.3 for v in (1, 2)}
    labelled = C.label(R.from_voxels(H.voxel_table(spark, volumes).drop("value")), k, tile=4)
    for v, mask in volumes.items():
        want = H.components(mask, k)
        got = np.zeros(mask.shape, int)
        for r in labelled.filter(f"vol_id = {v}").collect():
            got[r.z, r.y, r.x0:r.x1 + 1] = r.component
        assert (got == want).all()
