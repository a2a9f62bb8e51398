"""Packed tiles, counts over bricks, sweeps over runs, and what avoids rows for voxels or pairs."""

import os
import tempfile
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers as H
from voxmill.functions import bricks, numeric, tiles
from voxmill.functions import quantiles as Q
from voxmill.functions import runs as R
from voxmill.operators import background as B
from voxmill.operators import components as C
from voxmill.operators import distance as D
from voxmill.operators import evaluate as E
from voxmill.operators import features
from voxmill.operators import flood as W
from voxmill.operators import intensity as I
from voxmill.operators import select as S
from voxmill.params import Flatten
from voxmill.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tile, corners", [(4, True), (4, False), (64, True)])
def test_a_tile_gets_its_values_and_one_layer_around(spark, tile, corners):
    rng = np.random.default_rng(1)
    a = np.where(rng.random((9, 10, 70)) < 0.4, rng.integers(1, 99, (9, 10, 70)), 0)
    rows = bricks.from_voxels(H.voxel_table(spark, {1: a}, "v", keep_zero=True), "v", "long")
    met = tiles.exchange(rows, "v", tile, corners).toArrow().to_pandas()
    padded = np.pad(a, [(1, tile + 1)] * 3)
    for (tz, ty, tx), group in met.groupby(["tz", "ty", "tx"]):
        if min(tz, ty, tx) < 0:
            continue
        low = [t * tile - 1 for t in (tz, ty, tx)]
        cube = np.zeros((tile + 2,) * 3, int)
        for r in group.itertuples():
            cube[r.z - low[0], r.y - low[1], r.x0 - low[2]:r.x0 - low[2] + len(r.v)] = r.v
        want = padded[tuple(slice(c + 1, c + tile + 3) for c in low)]
        want = np.pad(want, [(0, m - n) for m, n in zip(cube.shape, want.shape)])
        if not corners:
            outside = sum((np.isin(np.arange(tile + 2), (0, tile + 1))).reshape([-1 if i == j else 1 for j in range(3)]).astype(int) for i in range(3))
            want = np.where(outside > 1, 0, want)
        assert (cube == want).all()


@pytest.mark.parametrize("across", [1, 2, 4])
def test_flood_in_blocks_of_tiles(spark, across, monkeypatch):
    monkeypatch.setattr(W, "ACROSS", across)
    rng = np.random.default_rng(13)
    mask = rng.random((17, 12, 20)) < 0.8
    marks = np.where(mask & (rng.random(mask.shape) < 0.01), 1, 0)
    cat = H.catalog(spark, {1: mask})
    markers = C.label(H.voxel_table(spark, {1: marks}).drop("value"))
    labels = W.flood(D.distance_bricks(R.from_voxels(H.voxel_table(spark, {1: mask}).drop("value")), cat), markers, 4)
    found = H.to_arrays(R.to_voxels(labels), {1: mask}, "label")[1]
    assert (found == H.spanning_flood(H.distance(mask), H.components(marks))).all()


def test_flood_shuffles_arrays_not_voxels(spark):
    mask = np.ones((20, 20, 20), bool)
    mask[0, 0, 0] = False
    cat = H.catalog(spark, {1: mask})
    rows = D.distance_bricks(R.from_voxels(H.voxel_table(spark, {1: mask}).drop("value")), cat)
    assert tiles.exchange(rows, "d2", 64, False).count() == 400  # one row a line


@pytest.mark.parametrize("tile, distance", [(4, 3), (8, 2), (64, 4)])
def test_peaks_across_tiles(spark, tile, distance):
    mask = np.random.default_rng(15).random((11, 12, 13)) < 0.85
    rows = D.distance_bricks(R.from_voxels(H.voxel_table(spark, {1: mask}).drop("value")), H.catalog(spark, {1: mask}))
    d2 = np.pad(H.distance(mask), 1)
    tops = sorted((-d2[p], tuple(int(c) - 1 for c in p)) for p in zip(*np.nonzero(d2)) if all(d2[tuple(np.add(p, s))] <= d2[p] for s in H.steps(3)))
    tops = [p for _, p in tops]
    assert sorted((r.z, r.y, r.x0) for r in W.peaks(rows, distance, tile).collect()) == sorted(tops[i] for i in H.greedy(tops, distance))


@pytest.mark.parametrize("tile", [3, 5, 64])
@pytest.mark.parametrize("min_dist", [1.0, 2.5, 4.0])
def test_suppression_across_tiles_equals_greedy(spark, tile, min_dist):
    rng = np.random.default_rng(int(min_dist * 10) + tile)
    points = [tuple(map(int, p)) for p in rng.integers(-3, 16, (300, 3))]
    scores = rng.integers(0, 4, 300)
    order = sorted(range(300), key=lambda i: (-scores[i], i))
    want = {order[j] for j in H.greedy([points[i] for i in order], min_dist)}
    table = spark.createDataFrame([(1, i, *points[i], int(scores[i])) for i in range(300)], "vol_id int, id int, z int, y int, x int, s int")
    kept = S.suppress(table, min_dist, [F.col("s").desc(), F.col("id").asc()], tile)
    assert {r.id for r in kept.collect()} == want and kept.columns == table.columns


@pytest.mark.parametrize("tile, times", [(64, 3), (32, 24)])
def test_a_plateau_stores_no_pairs(spark, tile, times):
    """All voxels of a cube, best first in raster order (the order that crosses tiles most often): pairs would be some 300 times the points."""
    side, stored = 64, []
    axis = spark.range(side).select(F.col("id").cast("int").alias("i"))
    cube = axis.withColumnRenamed("i", "z").crossJoin(axis.withColumnRenamed("i", "y")).crossJoin(axis.withColumnRenamed("i", "x"))
    points = cube.withColumn("vol_id", F.lit(1))
    real = S.store

    def counted(df, tag):
        out = real(df, tag)
        stored.append((tag, out.count()))
        return out

    with mock.patch.object(S, "store", counted):
        kept = S.suppress(points, 7, [F.col("z"), F.col("y"), F.col("x")], tile).count()
    assert 700 < kept < 3000
    assert sum(n for _, n in stored) < times * side**3, stored
    assert max(n for _, n in stored) <= side**3


def test_distance_takes_linear_steps():
    block = np.full((4096, 3), numeric.FAR)
    block[100, 0] = 0
    block[:, 1] = np.random.default_rng(2).integers(0, 4096, 4096) ** 2
    found, compared = numeric.parabolas(block)
    assert compared <= 2 * block.size
    assert (found[:, 0] == (np.arange(4096) - 100) ** 2).all() and (found[:, 2] >= numeric.FAR).all()
    assert (numeric.lower_envelope(block) == np.minimum(found, numeric.FAR)).all()
    at = np.arange(4096)
    for i in (0, 17, 2048, 4095):
        assert found[i, 1] == (block[:, 1] + (at - i) ** 2).min()


def test_envelopes_agree_with_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, c = rng.integers(1, 60), rng.integers(1, 6)
        block = np.where(rng.random((n, c)) < 0.6, numeric.FAR, rng.integers(0, 50, (n, c)) ** 2)
        want = np.minimum(numeric.FAR, (block[None] + ((np.arange(n)[:, None] - np.arange(n)) ** 2)[:, :, None]).min(axis=1))
        with mock.patch.object(numeric, "NEAR", int(rng.integers(1, 30))):
            assert (numeric.lower_envelope(block) == want).all()


def _volumes(seed=4):
    rng = np.random.default_rng(seed)
    return {1: rng.integers(0, 256, (3, 5, 150)), 2: rng.integers(90, 110, (4, 4, 64)), 3: np.zeros((1, 2, 3), int), 4: np.full((2, 2, 2), 7)}


@pytest.mark.parametrize("final", [Q.FINAL_ROWS, 20])
def test_quantiles_of_bricks_are_exact_and_not_unpacked(spark, final, monkeypatch):
    monkeypatch.setattr(Q, "FINAL_ROWS", final)
    rng = np.random.default_rng(6)
    volumes = _volumes()
    rows = bricks.from_voxels(H.voxel_table(spark, volumes, "v", keep_zero=True), "v")
    rows = bricks.with_values(rows, ["v"], [], "v", "float", lambda v: v * np.float32(1.7)).repartition(5)
    found = Q.brick_quantiles(rows, "v", [0.5, 50.0, 99.5], ["a", "b", "c"], positive=True)
    assert "Explode" not in _plan(found) and "explode" not in _plan(found)
    for r in found.collect():
        values = volumes[r.vol_id].astype(np.float32) * np.float32(1.7)
        values = values[values > 0] if (values > 0).any() else values
        assert np.allclose([r.a, r.b, r.c], np.percentile(values.astype(float), [0.5, 50, 99.5]), rtol=1e-12)
    assert found.count() == len(volumes)
    odd = bricks.with_values(rows, ["v"], [], "v", "float", lambda v: v * np.float32("nan"))
    with pytest.raises(Exception, match="finite"):
        Q.brick_quantiles(odd, "v", [50.0], ["m"]).collect()
    assert rng is not None and Q.brick_quantiles(rows.filter("false"), "v", [50.0], ["m"]).count() == 0


def test_bricks_give_the_masks_and_counts_of_voxels(spark):
    volumes = _volumes(5)
    voxels = H.voxel_table(spark, volumes, "gray", keep_zero=True)
    rows = bricks.from_voxels(voxels, "gray", "int").withColumnRenamed("v", "gray").repartition(4)
    as_set = lambda df: sorted(map(tuple, df.collect()))
    assert as_set(I.histogram(rows)) == as_set(I.histogram(voxels))
    limits = spark.createDataFrame([(1, 128), (2, 100), (3, 0), (4, None)], "vol_id int, threshold int")
    runs = I.dark_mask(rows, limits, "gray")
    assert as_set(runs) == as_set(R.from_voxels(I.dark_mask(voxels, limits, "gray")))
    assert as_set(I.foreground_mask(rows, -10.0)) == as_set(R.from_voxels(I.foreground_mask(voxels, -10.0)))
    sums = bricks.line_sums(rows, "gray")
    plain = voxels.groupBy("vol_id", "z", "y").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("gray").alias("sum_v"), F.sum(F.col("gray") * (F.col("x") + 1)).alias("sum_vx"))
    assert as_set(sums) == as_set(plain)


def test_flattening_makes_no_voxel_rows(spark):
    volumes = {v: a for v, a in _volumes(7).items() if v < 3}
    voxels = H.voxel_table(spark, volumes, "gray", keep_zero=True)
    flat = B.flatten_bricks(voxels, Flatten(lambda_xy=2.0))
    assert "xplode" not in _plan(flat)
    got = H.to_arrays(bricks.to_voxels(flat), volumes, "flat")
    unpacked = B.flatten(voxels, Flatten(lambda_xy=2.0))
    assert unpacked.columns == ["vol_id", "z", "y", "x", "flat"] and unpacked.count() == sum(a.size for a in volumes.values())
    assert all(0 <= got[v].min() and got[v].max() == 255 for v in volumes)


def test_sweep_of_runs_equals_comparison_of_voxels(spark):
    rng = np.random.default_rng(8)
    gt = {v: rng.integers(0, 4, (4, 5, 90)) * (rng.random((4, 5, 90)) < 0.8) for v in (1, 2)}
    pred = {1: np.repeat(rng.integers(0, 3, (4, 5, 30)), 3, axis=2), 3: np.ones((1, 1, 1), int)}
    shapes = {1: gt[1], 2: gt[2], 3: pred[3]}
    cat = H.catalog(spark, shapes)
    voxels = [H.voxel_table(spark, side, "label") for side in (gt, pred)]
    runs = [R.from_voxels(v, ("label",)) for v in voxels]
    want = {}
    for v, a in shapes.items():
        face = np.ones(a.shape, bool)
        face[tuple(slice(1, -1) for _ in range(3))] = False
        for g, p, f in zip(gt.get(v, np.zeros_like(a)).ravel().tolist(), pred.get(v, np.zeros_like(a)).ravel().tolist(), face.ravel().tolist()):
            if g or p:
                n, b = want.get((v, g, p), (0, 0))
                want[v, g, p] = (n + 1, b + f)
    for sides in (voxels, runs):
        table = E.contingency(E.align(*sides), cat)
        assert {(r.vol_id, r.gt_id, r.pred_id): (r.n, r.border) for r in table.collect()} == want
    swept = E.align(*runs)
    marks = E.marker_tallies(swept.withColumnRenamed("pred_id", "marker_id")).filter("vol_id = 1").first()
    assert marks.marker_voxels_on_gt == ((gt[1] > 0) & (pred[1] > 0)).sum() and marks.marker_voxels_on_background == ((gt[1] == 0) & (pred[1] > 0)).sum()


def test_crops_read_only_their_part(spark):
    voxels = spark.range(128 * 128 * 64).select(
        F.lit(1).alias("vol_id"), (F.col("id") % 64).cast("int").alias("z"), F.expr("cast(id / 64 as int) % 128").alias("y"), F.expr("cast(id / 8192 as int)").alias("x"),
        (F.col("id") % 251).cast("int").alias("gray"))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "v")
    tables.write_voxels(voxels, path)
    stored = spark.read.parquet(path)
    box = spark.createDataFrame([("a", 70, 3, 2, 20)], "crop_id string, x int, y int, z int, size int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cut = tables.cut_crops(stored, box)
        assert cut.count() == 20**3
        plan = _plan(cut)
        assert "PushedFilters: [" in plan and "GreaterThanOrEqual(z,2)" in plan.replace("[", "(") or "GreaterThanOrEqual(" in plan
        execution = cut._jdf.queryExecution()
        execution.toRdd().count()
        leaves = execution.executedPlan().collectLeaves()
        scan = next(leaves.apply(k) for k in range(leaves.size()) if "Scan parquet" in leaves.apply(k).nodeName() and "gray" in leaves.apply(k).toString())
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert read < voxels.count() / 2
    many = box.crossJoin(spark.range(100).select(F.col("id").cast("int").alias("k"))).select(F.concat("crop_id", F.col("k").cast("string")).alias("crop_id"), (F.col("x") - F.col("k") % 3).alias("x"), "y", "z", "size")
    assert tables.cut_crops(stored, many).filter("crop_id = 'a0'").count() == 20**3
    assert tables.cut_crops(stored, box.filter("false")).count() == 0


def test_voxels_are_packed_before_they_are_shuffled(spark):
    """Rows in any order give the same bricks; null values stay, a null position is an error."""
    volumes = _volumes()
    voxels = H.voxel_table(spark, volumes, "v", keep_zero=True)
    want = {(r.vol_id, r.z, r.y, r.xb): r.v for r in bricks.from_voxels(voxels.orderBy("vol_id", "z", "y", "x"), "v", "int").collect()}
    assert want == {(v, z, y, b): a[z, y, b * 64:b * 64 + 64].tolist() for v, a in volumes.items()
                    for z in range(a.shape[0]) for y in range(a.shape[1]) for b in range((a.shape[2] + 63) // 64)}
    mixed = bricks.from_voxels(voxels.repartition(5, "x"), "v", "int")
    assert {(r.vol_id, r.z, r.y, r.xb): r.v for r in mixed.collect()} == want
    for pack in (lambda v: bricks.from_voxels(v, "v", "int"), lambda v: features.pack_lines(v, "v")):
        assert "MapInArrow" in _plan(pack(voxels)).split("Exchange")[-1]
    empty = bricks.from_voxels(voxels.withColumn("v", F.when(F.col("x") != 1, F.col("v"))), "v", "int").filter("xb = 0").first()
    assert empty.v[1] is None and empty.v[0] is not None
    with pytest.raises(Exception, match="missing or doubled"):
        bricks.from_voxels(voxels.withColumn("x", F.when(F.col("x") != 0, F.col("x"))), "v", "int").collect()
