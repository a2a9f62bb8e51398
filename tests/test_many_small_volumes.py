"""Many small volumes share a call: distance, flooding and peaks."""

import helpers as H
import numpy as np
import pyarrow as pa
import pytest

from voxmill.functions import bricks, tiles
from voxmill.functions import runs as R
from voxmill.operators import components as C
from voxmill.operators import distance as D
from voxmill.operators import flood as W
from voxmill.operators import select as S
from voxmill.session import store


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def volumes():
    """Of differing sizes, one past a brick and a tile."""
    rng = np.random.default_rng(21)
    shapes = [(3, 4, 5)] * 20 + [(9, 7, 12), (5, 6, 70), (1, 1, 1), (6, 6, 6)]
    found = {v: rng.random(shape) < 0.8 for v, shape in enumerate(shapes)}
    found[23][:] = True
    return found


@pytest.fixture(scope="module")
def mask(spark, volumes):
    return store(R.from_voxels(H.voxel_table(spark, volumes).drop("value")), "mask")


@pytest.mark.parametrize("whole", [1 << 14, 0])
def test_distance_of_many_volumes_in_one_call(spark, volumes, mask, whole, monkeypatch):
    monkeypatch.setattr(D, "WHOLE", whole)
    cat = H.catalog(spark, volumes)
    rows = D.distance_bricks(mask, cat)
    assert "FlatMapGroupsInArrow" not in _plan(rows) and (not whole or _plan(rows).count("Exchange hashpartitioning") == 1)
    some = {v: m for v, m in volumes.items() if not m.all()}
    found = H.to_arrays(D.distance(mask.filter(f"vol_id in ({', '.join(map(str, some))})"), cat), some, "d2")
    assert all((found[v] == H.distance(m)).all() for v, m in some.items())
    assert D.distance(mask.filter("vol_id = 23"), cat).filter("d2 is null").count() == 216


@pytest.mark.parametrize("tile, dealt", [(4, 64), (4, 0), (16, 64), (64, 64)])
def test_flood_of_many_volumes(spark, volumes, mask, tile, dealt, monkeypatch):
    monkeypatch.setattr(W, "DEALT", dealt)
    some = {v: m for v, m in volumes.items() if not m.all()}
    rng = np.random.default_rng(22)
    marks = {v: np.where(m & (rng.random(m.shape) < 0.03), 1, 0) for v, m in some.items()}
    cat = H.catalog(spark, some)
    labels = W.flood(D.distance_bricks(mask, cat), C.label(H.voxel_table(spark, marks).drop("value")), tile)
    found = H.to_arrays(R.to_voxels(labels), some, "label")
    for v, m in some.items():
        assert (found[v] == H.spanning_flood(H.distance(m), H.components(marks[v]))).all()


def test_edges_inside_a_block_are_joined_in_its_task(spark):
    """A block of small tiles leaves no link between its own tiles, and many blocks are one call."""
    d2 = H.distance(np.random.default_rng(23).random((12, 12, 12)) < 0.8)
    lines = [(v, z, y, d2[z, y].tolist()) for v in range(30) for z in range(12) for y in range(12) if d2[z, y].any()]
    vol, z, y, values = zip(*lines)
    n = len(lines)
    table = pa.table({
        **{k: pa.array(c, pa.int32()) for k, c in (("vol_id", vol), ("tz", [0] * n), ("ty", [0] * n), ("tx", [0] * n), ("z", z), ("y", y), ("x0", [0] * n), ("x1", [0] * n))},
        "label": pa.array([0] * n, pa.int64()), "v": pa.array(values, pa.list_(pa.int64()))})
    found = list(W._flood_tiles(4, 16)(table))
    assert len(found) == 1 and sum(found[0]["kind"].to_pylist()) == 0


def test_cubes_hold_all_groups_within_the_bound():
    rng = np.random.default_rng(24)
    own = np.sort(rng.integers(0, 9, 60))
    z, y = np.arange(60) // 8, np.arange(60) % 8
    rows = [rng.integers(0, 3, rng.integers(1, 6)) for _ in range(60)]
    rows[-1][:] = 7
    seen, batches = [], 0
    for groups, cube, low in tiles.cubes(own, z, y, np.full(60, 2), pa.array([r.tolist() for r in rows]), 400):
        batches += 1
        assert cube.size <= 400 or len(groups) == 1
        seen += [(groups[g], *(c + low[g]), cube[g, *c]) for g, *c in np.argwhere(cube)]
    want = [(own[k], z[k], y[k], 2 + x, v) for k, r in enumerate(rows) for x, v in enumerate(r) if v]
    assert batches > 1 and sorted(map(lambda r: tuple(map(int, r)), seen)) == sorted(map(lambda r: tuple(map(int, r)), want))


def test_runs_of_lines_in_one_brick_are_not_shuffled(spark):
    for width, shuffles in ((24, False), (70, True)):
        values = {1: np.random.default_rng(25).integers(0, 3, (2, 3, width))}
        voxels = H.voxel_table(spark, values, "v", keep_zero=True)
        rows = bricks.from_voxels(voxels, "v", "int").localCheckpoint().selectExpr("*", "1 as level")
        found = bricks.runs_where(rows, "v", "level", np.greater_equal)
        assert ("Exchange" in _plan(found)) == shuffles
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, R.from_voxels(voxels.filter("v >= 1")).collect()))


def test_points_go_to_no_tile_beyond_all_points(spark, monkeypatch):
    """Small volumes, whose points all lie near the border of the first tile: one row a point, and many volumes a call."""
    monkeypatch.setattr(S, "discard", lambda *_: None)
    rng = np.random.default_rng(26)
    places = [(v, *map(int, p)) for v in range(12) for p in rng.integers(0, 7, (30, 3))]
    points = spark.createDataFrame([(*p, k) for k, p in enumerate(places)], "vol_id int, z int, y int, x int, k int")
    dealt, real = [], S._around_tiles

    def counted(*given):
        found = real(*given)
        dealt.append((found.count(), given[0].count()))
        return found

    monkeypatch.setattr(S, "_around_tiles", counted)
    kept = {r.k for r in S.suppress(points, 3.0, [S.F.col("k").asc()]).collect()}
    assert dealt and all(rows == n for rows, n in dealt)
    for v in range(12):
        own = [k for k, p in enumerate(places) if p[0] == v]
        assert {own[i] for i in H.greedy([places[k][1:] for k in own], 3.0)} == kept & set(own)


def test_a_number_a_volume_is_broadcast_further(spark, monkeypatch):
    from voxmill import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    big = session.store(spark.range(300).selectExpr("cast(id as int) vol_id", "id piece"), "big")
    for n, narrow, broadcast in ((40, True, True), (60, True, False), (40, False, False)):
        small = big.limit(n).selectExpr("vol_id", "1 as level" if narrow else "'a' as level")
        met = session.lookup_join(big, small, ["vol_id"])
        assert ("BroadcastHashJoin" in _plan(met)) == broadcast and met.count() == n
