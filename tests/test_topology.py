import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers as H
from voxmill.functions import runs as R
from voxmill.operators import components as C
from voxmill.operators import distance as D
from voxmill.operators import morphology as M
from voxmill.operators.flood import flood, peaks


@pytest.fixture(scope="module")
def random_masks():
    rng = np.random.default_rng(7)
    return {
        1: rng.random((9, 10, 11)) < 0.45,
        2: rng.random((6, 7, 13)) < 0.3,
        3: rng.random((5, 5, 5)) < 0.7,
    }


@pytest.fixture(scope="module")
def masks(spark, random_masks):
    return H.voxel_table(spark, random_masks).drop("value")


@pytest.mark.parametrize("k,tile", [(1, 64), (1, 4), (2, 4), (3, 4), (2, 3), (3, 3)])
def test_components_match_raster_labels(masks, random_masks, k, tile):
    labelled = R.to_voxels(C.label(masks, k, tile))
    found = H.to_arrays(labelled, random_masks, "component")
    for v, mask in random_masks.items():
        assert (found[v] == H.components(mask, k)).all()


def test_touching_by_face_edge_corner(spark):
    a = np.zeros((7, 7, 7), bool)
    a[0, 0, 0] = a[0, 0, 1] = True
    a[2, 2, 2] = a[2, 3, 3] = True
    a[4, 4, 4] = a[5, 5, 5] = True
    table = H.voxel_table(spark, {1: a}).drop("value")
    counts = [C.label(table, k).select("component").distinct().count() for k in (1, 2, 3)]
    assert counts == [5, 4, 3]


def test_long_snake_across_many_tiles(spark):
    a = np.zeros((1, 20, 20), bool)
    a[0, ::2] = True
    a[0, 1::4, -1] = a[0, 3::4, 0] = True
    found = C.label(H.voxel_table(spark, {1: a}).drop("value"), 1, 2)
    assert found.select("component").distinct().count() == 1


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_morphology(spark, masks, random_masks, radius):
    cat = H.catalog(spark, random_masks)
    runs = R.from_voxels(masks)
    grown = H.mask_arrays(M.dilate(runs, cat, radius), random_masks)
    shrunk = H.mask_arrays(M.erode(runs, cat, radius), random_masks)
    closed = H.mask_arrays(M.close(runs, cat, radius), random_masks)
    for v, mask in random_masks.items():
        assert (grown[v] == H.dilate(mask, radius)).all()
        assert (shrunk[v] == H.erode(mask, radius)).all()
        assert (closed[v] == H.erode(H.dilate(mask, radius), radius)).all()


def test_shell_with_and_without_hole(spark):
    closed = np.zeros((7, 7, 7), bool)
    closed[1:6, 1:6, 1:6] = True
    closed[2:5, 2:5, 2:5] = False
    pierced = closed.copy()
    pierced[1, 3, 3] = False
    volumes = {1: closed, 2: pierced}
    cat = H.catalog(spark, volumes)
    runs = R.from_voxels(H.voxel_table(spark, volumes).drop("value"))
    filled = H.mask_arrays(C.fill_holes(runs, cat, tile=3), volumes)
    assert filled[1].sum() == 125 and filled[2].sum() == pierced.sum()
    split = C.split_external(R.complement(runs, cat), cat, 1, 3)
    inside = split.filter("not external").groupBy("vol_id").agg(F.sum(R.length()).alias("n")).collect()
    assert [(r.vol_id, r.n) for r in inside] == [(1, 27)]


def test_drop_small_and_relabel(spark, masks, random_masks):
    kept = H.mask_arrays(C.drop_small(masks, 4, tile=4), random_masks)
    for v, mask in random_masks.items():
        lab = H.components(mask)
        sizes = np.bincount(lab.ravel())
        assert (kept[v] == ((lab > 0) & (sizes[lab] >= 4))).all()
    labels = spark.createDataFrame(
        [(1, 0, 0, x, lab) for x, lab in enumerate([9, 9, 70000, 70000, 5, 3, 3])],
        "vol_id int, z int, y int, x int, label int",
    )
    got = {r.x: r.label for r in C.drop_small_labels(labels, 2).collect()}
    assert got == {5: 1, 6: 1, 0: 2, 1: 2, 2: 3, 3: 3}


def test_distance_is_exact(spark, masks, random_masks):
    cat = H.catalog(spark, random_masks)
    found = H.to_arrays(D.distance(R.from_voxels(masks), cat), random_masks, "d2")
    for v, mask in random_masks.items():
        assert (found[v] == H.distance(mask)).all()


def test_distance_over_several_bricks_and_empty_lines(spark):
    a = np.ones((3, 4, 150), bool)
    a[1, 2, 100] = False
    full = np.ones((2, 2, 2), bool)
    volumes = {1: a, 2: full}
    rows = D.distance(R.from_voxels(H.voxel_table(spark, volumes).drop("value")), H.catalog(spark, volumes))
    found = H.to_arrays(rows.filter("vol_id = 1"), volumes, "d2")
    assert (found[1] == H.distance(a)).all()
    assert rows.filter("vol_id = 2 and d2 is null and distance is null").count() == 8


@pytest.mark.parametrize("tile", [64, 4])
def test_flood_equals_spanning_forest(spark, tile):
    rng = np.random.default_rng(3)
    volumes, marks = {}, {}
    for v in (1, 2, 3):
        noise = rng.random((8, 9, 10))
        volumes[v] = noise < (0.6, 0.8, 0.5)[v - 1]
        marks[v] = np.where(volumes[v] & (rng.random(noise.shape) < 0.04), 1, 0)
    cat = H.catalog(spark, volumes)
    mask = R.from_voxels(H.voxel_table(spark, volumes).drop("value"))
    markers = C.label(H.voxel_table(spark, marks).drop("value"))
    found = H.to_arrays(R.to_voxels(flood(D.distance_bricks(mask, cat), markers, tile)), volumes, "label")
    agreed = total = 0
    for v, mask_ in volumes.items():
        d2, seeds = H.distance(mask_), H.components(marks[v])
        assert (found[v] == H.spanning_flood(d2, seeds)).all()
        queue = H.queue_flood(d2, seeds)
        assert ((queue > 0) == (found[v] > 0)).all()
        agreed += ((queue == found[v]) & mask_).sum()
        total += mask_.sum()
    print(f"agreement with a priority-queue flood on noise: {agreed / total:.3f}")


def test_flood_two_markers_and_unreached_grain(spark):
    a = np.zeros((5, 5, 15), bool)
    a[1:4, 1:4, 1:6] = True
    a[1:4, 1:4, 8:14] = True
    m = np.zeros(a.shape, int)
    m[2, 2, 2] = m[2, 2, 4] = 1
    m[0, 0, 0] = 1
    cat = H.catalog(spark, {1: a})
    mask = R.from_voxels(H.voxel_table(spark, {1: a}).drop("value"))
    inside = C.restrict_markers(R.from_voxels(H.voxel_table(spark, {1: m}).drop("value")), mask)
    assert inside.count() == 2
    found = H.to_arrays(R.to_voxels(flood(D.distance_bricks(mask, cat), inside)), {1: a}, "label")[1]
    assert set(found[1:4, 1:4, 1:6].ravel()) == {1, 2} and (found[:, :, 7:] == 0).all()
    assert found[2, 2, 2] == 1 and found[2, 2, 4] == 2


def test_peaks_are_apart_and_complete(spark):
    rng = np.random.default_rng(5)
    volumes = {1: rng.random((10, 10, 12)) < 0.8}
    cat = H.catalog(spark, volumes)
    rows = D.distance_bricks(R.from_voxels(H.voxel_table(spark, volumes).drop("value")), cat)
    found = sorted((r.z, r.y, r.x0) for r in peaks(rows, 3).collect())
    d2 = np.pad(H.distance(volumes[1]), 1)
    tops = []
    for p in zip(*np.nonzero(d2)):
        if all(d2[tuple(np.add(p, s))] <= d2[p] for s in H.steps(3)):
            tops.append((-d2[p], tuple(int(c) - 1 for c in p)))
    tops = [p for _, p in sorted(tops)]
    assert found == sorted(tops[i] for i in H.greedy(tops, 3))


def test_large_lookups_of_small_files_are_not_broadcast(spark, monkeypatch):
    """Spark takes compressed files for the size of a table; the number of rows decides."""
    from voxmill import session

    big = session.store(spark.range(3000).selectExpr("cast(id % 7 as int) vol_id", "id piece"), "big")
    small = session.store(big.withColumn("v", F.lit(1)), "small")
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    met = session.lookup_join(big, small, ["vol_id", "piece"])
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 3000
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10_000)
    met = session.lookup_join(big, small, ["vol_id", "piece"])
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()
