import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers as H
from voxmill.functions import runs as R
from voxmill.functions.quantiles import exact_quantiles
from voxmill.functions.ranking import number_by_bucket, number_in_order
from voxmill.operators import features as feat
from voxmill.operators import select as S
from voxmill.params import PRESETS, MarkerRules, Sampling


@pytest.mark.parametrize("min_dist", [1.0, 3.0, 4.5])
def test_suppression_equals_greedy(spark, min_dist):
    rng = np.random.default_rng(11)
    rows, want = [], set()
    for vol in range(4):
        points = [tuple(map(int, p)) for p in rng.integers(0, 9, (60, 3))]
        scores = rng.integers(0, 5, 60)
        order = sorted(range(60), key=lambda i: (-scores[i], i))
        want |= {(vol, order[j]) for j in H.greedy([points[i] for i in order], min_dist)}
        rows += [(vol, i, *points[i], int(scores[i])) for i in range(60)]
    table = spark.createDataFrame(rows, "vol_id int, id int, z int, y int, x int, s int")
    kept = S.suppress(table, min_dist, [F.col("s").desc(), F.col("id").asc()])
    assert {(r.vol_id, r.id) for r in kept.collect()} == want


def test_suppression_at_exact_distance(spark):
    rows = [(1, 1, 0, 0, 0), (1, 2, 0, 0, 3), (1, 3, 0, 0, 5)]
    table = spark.createDataFrame(rows, "vol_id int, id int, z int, y int, x int")
    kept = S.suppress(table, 3, [F.col("id").asc()])
    assert sorted(r.id for r in kept.collect()) == [1, 2]


def _candidates(spark, n):
    rows = [(1, i, 5.0, 3, 1.0, 0, 0, 10 * i) for i in range(n)]
    return spark.createDataFrame(
        rows, "vol_id int, component long, score double, area long, elongation double, cz int, cy int, cx int"
    )


def test_marker_cap_and_ties(spark):
    kept = S.suppress_markers(_candidates(spark, 5), 7.0, 2)
    assert sorted((r.component, r.new_label) for r in kept.collect()) == [(0, 1), (1, 2)]
    assert S.suppress_markers(_candidates(spark, 5), 7.0, 0).count() == 5


def test_numbering_is_dense_per_volume(spark):
    rows = [(v, int(k)) for v in range(3) for k in np.random.default_rng(v).permutation(500) * 37]
    table = spark.createDataFrame(rows, "vol_id int, k long")
    for numbered in (
        number_by_bucket(table, "k", F.shiftright("k", 8), "i"),
        number_in_order(table, [F.col("k").asc()], "i"),
    ):
        got = {(r.vol_id, r.k): r.i for r in numbered.collect()}
        assert got == {(v, k): k // 37 + 1 for v, k in rows}


def test_quantiles_are_exact_also_after_splitting(spark, monkeypatch):
    from voxmill.functions import quantiles

    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=3000), 1: np.repeat(4.0, 900), 2: np.append(rng.random(2000), 1e12)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    table = spark.createDataFrame(rows, "g int, v double").repartition(4)
    for limit in (10**6, 20):
        monkeypatch.setattr(quantiles, "FINAL_ROWS", limit)
        got = {r.g: r for r in exact_quantiles(table, ["g"], "v", [0.5, 50, 99.5], ["a", "b", "c"]).collect()}
        for g, vs in groups.items():
            want = np.percentile(vs, [0.5, 50, 99.5])
            assert np.allclose([got[g].a, got[g].b, got[g].c], want, rtol=1e-12, atol=1e-12)


def test_features_at_a_corner(spark):
    rng = np.random.default_rng(8)
    gray = rng.integers(0, 255, (6, 7, 8))
    comp = np.zeros(gray.shape, int)
    comp[0, 0, 0] = comp[0, 0, 1] = 1
    comp[3:5, 3, 3:7] = 2
    volumes = {1: gray}
    cat = H.catalog(spark, volumes)
    comps = R.from_voxels(H.voxel_table(spark, {1: comp}, "component"), ("component",))
    points = feat.centroids(feat.shapes(comps), cat)
    lines = feat.pack_lines(H.voxel_table(spark, volumes, "gray", keep_zero=True), "gray")
    got = {r.component: r for r in feat.contrasts(points, lines, cat, Sampling(1, 1, 3)).collect()}
    for c in (1, 2):
        where = np.argwhere(comp == c)
        cz, cy, cx = np.rint(where.mean(axis=0)).astype(int)
        near = [gray[z, y, x] for z, y, x in np.ndindex(gray.shape)
                if (z - cz) ** 2 + (y - cy) ** 2 + (x - cx) ** 2 <= 1]
        ring = [gray[cz, y, x] for y, x in np.ndindex(gray.shape[1:]) if 1 < (y - cy) ** 2 + (x - cx) ** 2 <= 9]
        assert np.isclose(got[c].center_mean, np.mean(near)) and np.isclose(got[c].ring_mean, np.mean(ring))
    at = {r.component: (r.cz, r.cy, r.cx) for r in points.collect()}
    assert at == {1: (0, 0, 0), 2: (4, 3, 4)}


def test_every_marker_rule_is_named(spark):
    volumes = {1: np.full((20, 20, 40), 200)}
    core = volumes[1].copy()
    comp = np.zeros(core.shape, int)
    comp[2, 2, 2] = 1
    comp[5, 5, 2:38] = 2
    comp[10:13, 10, 10:13] = 3
    core[10:13, 9:12, 9:14] = 20
    comp[16:18, 15:17, 30:33] = 4
    core[15:19, 13:19, 28:35] = 254
    cat = H.catalog(spark, volumes)
    comps = R.from_voxels(H.voxel_table(spark, {1: comp}, "component"), ("component",))
    lines = feat.pack_lines(H.voxel_table(spark, {1: core}, "gray", keep_zero=True), "gray")
    judged = S.marker_features(comps, lines, cat, MarkerRules())
    assert {r.component: r.reason for r in judged.collect()} == {1: "area", 2: "shape", 3: "candidate", 4: "center"}
    report = S.marker_report(judged, S.suppress_markers(judged.filter("reason = 'candidate'"), 7.0, 420))
    rows = {r.component_id: r for r in report.collect()}
    assert (rows[1].dx, rows[1].fill, rows[1].center_mean) == (0, 0.0, 0.0)
    assert (rows[2].dx, rows[2].center_mean) == (36, 0.0)
    assert rows[3].reason == "keep" and rows[3].new_label == 1


def test_presets():
    assert PRESETS["production"].flood.force_markers and not PRESETS["default"].flood.force_markers
    assert PRESETS["production"].seeds.nms_min_dist == 5.0
    assert PRESETS["fixture"].scoring.min_gt_area == 20
