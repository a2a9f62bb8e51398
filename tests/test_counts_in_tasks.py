"""Voxels are counted by the task that reads them where the catalog is large."""

import numpy as np

from voxmill import session
from voxmill.operators import evaluate


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contingency_joins_counts_not_voxels(spark, monkeypatch):
    """Also where the catalog is too large to broadcast, in any order of the voxels."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(3)
    shapes, rows, want = {1: (4, 5, 6), 2: (7, 3, 4)}, [], {}
    for v, shape in shapes.items():
        gt, pred = rng.integers(0, 4, shape), rng.integers(0, 3, shape)
        for at in np.ndindex(shape):
            pair = (v, int(gt[at]), int(pred[at]))
            rows.append((v, *at, *pair[1:]))
            if any(pair[1:]):
                face = any(c in (0, m - 1) for c, m in zip(at, shape))
                n, border = want.get(pair, (0, 0))
                want[pair] = n + 1, border + face
    voxels = spark.createDataFrame(rows, "vol_id int, z int, y int, x int, gt_id int, pred_id int").repartition(3)
    catalog = spark.createDataFrame([(v, *s) for v, s in shapes.items()], "vol_id int, depth int, height int, width int")
    table = evaluate.contingency(voxels, catalog)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in table.collect()} == want
    assert "MapInArrow" in _plan(table)
    monkeypatch.undo()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in evaluate.contingency(voxels, catalog).collect()} == want
