"""Gray values are shuffled once, packed: by tile for sampling, by whole planes for filters."""

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import bricks
from voxmill.operators import background
from voxmill.operators import features as feat
from voxmill.params import Sampling
from voxmill.sources import fixtures


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def gray():
    """Past one tile along y and x."""
    return {1: np.random.default_rng(2).integers(0, 300, (3, 67, 70)), 2: np.full((2, 3, 4), 70_000)}


def test_sampling_meets_tiles_not_stretches(spark, gray):
    voxels, cat = H.voxel_table(spark, gray, "gray", keep_zero=True), H.catalog(spark, gray)
    places = [(1, 1, 1, 63, 64), (1, 2, 0, 0, 0), (1, 3, 2, 66, 69), (1, 4, 1, 64, 30), (2, 1, 1, 1, 1)]
    points = spark.createDataFrame(places, "vol_id int, component long, cz int, cy int, cx int")
    lines = feat.pack_lines(voxels, "gray")
    for packed in (lines, lines.repartition(5), feat.pack_tiles(voxels, "gray"), feat.pack_tiles(voxels.repartition(3), "gray")):
        found = feat.contrasts(points, packed, cat, Sampling(2, 4, 10))
        assert _plan(found).count("_in_pieces") <= 1  # both means from one table of values
        got = {(r.vol_id, r.component): (r.center_mean, r.ring_mean) for r in found.collect()}
        assert len(got) == len(places)
        for vol, component, cz, cy, cx in places:
            z, y, x = np.indices(gray[vol].shape)
            flat = (y - cy) ** 2 + (x - cx) ** 2
            near, ring = flat + (z - cz) ** 2 <= 4, (z == cz) & (flat > 16) & (flat <= 100)
            want = gray[vol][near].mean(), gray[vol][ring].mean() if ring.any() else 0.0
            assert np.allclose(got[vol, component], want, rtol=1e-12)
    for odd in (voxels.filter("x <> 5 or y <> 1"), voxels.filter("x <> 0 or y <> 1"), voxels.union(voxels.filter("x = 69")),
                voxels.withColumn("gray", F.when(F.col("x") != 2, F.col("gray")))):
        with pytest.raises(Exception, match="missing or doubled|no value"):
            feat.contrasts(points, feat.pack_tiles(odd, "gray"), cat, Sampling(2, 4, 10)).collect()


@pytest.mark.parametrize("sigma_z", [0.0, 1.5])
def test_whole_planes_give_the_same_bits(spark, gray, sigma_z, monkeypatch):
    voxels = H.voxel_table(spark, gray, "gray", keep_zero=True)
    key = lambda df: sorted((tuple(r[:4]), r.v, r.bg) for r in df.collect())
    whole = background.gaussian_background(voxels, 3.0, sigma_z)
    assert _plan(whole).count("Exchange") == 1
    of_bricks = background.gaussian_background(bricks.from_voxels(voxels, "gray"), 3.0, sigma_z)
    monkeypatch.setattr(background, "_WHOLE", 0)
    want = key(background.gaussian_background(voxels, 3.0, sigma_z))
    assert key(whole) == want and key(of_bricks) == want


def test_lines_hold_the_voxels(spark, tmp_path):
    spark.createDataFrame([(k, 7 * k % 50) for k in range(40)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    packed = fixtures.bricks(spark, str(tmp_path), "gray")
    voxels = fixtures.voxels(spark, str(tmp_path))
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, bricks.from_voxels(voxels, "gray", "int").collect()))
    assert "MapInArrow" not in _plan(packed)  # no voxel row is made or handed to Python
