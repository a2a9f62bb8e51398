"""The voxel table of the test volumes."""

from itertools import product

from voxmill.sources import fixtures


def _plain(grains, vol_id):
    """Every voxel of one volume from its grains ``(g, cz, cy, cx, r)``."""
    for z, y, x in product(range(fixtures.SIDE), repeat=3):
        hits = [((z - cz) ** 2 + (y - cy) ** 2 + (x - cx) ** 2, g, r, x - cx) for g, cz, cy, cx, r in grains]
        d2, g, r, dx = min((h for h in hits if h[0] <= h[2] ** 2), default=(None, 0, 0, 0))
        core = d2 is not None and 9 * d2 <= r * r
        gray = (30 if d2 is None else 20 if core else 170) + (x * 7 + y * 13 + z * 29 + vol_id * 31) % 41
        if d2 is None or g % 11 == 0 or d2 > r * r - 1:
            pred = 0
        else:
            pred = g + 100 if g % 5 == 0 and dx >= 0 else g - 2 if g % 7 == 0 else g
        seed = int(core or (d2 is None and (x + 2 * y + 3 * z) % 97 == 0))
        yield vol_id, z, y, x, gray, g, pred, g if core else 0, seed


def test_volumes_are_painted_without_a_shuffle_of_voxels(spark, tmp_path):
    """Equals the plain rule, also with a key twice and a size that is null; no voxel row is shuffled."""
    parts = [(k, 7 * k % 50) for k in (*range(3, 64), 5, 40)] + [(66, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    table = fixtures.build_voxels(spark, str(tmp_path))
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]
    assert not any("Exchange" in line and "z#" in line for line in plan.splitlines())

    wanted = []
    for vol_id in (0, 1, 2):
        mine = [(k, s) for k, s in parts if k // 32 == vol_id and s is not None]
        grains = [(k % 32 + 1, (k * 7 + 3) % 24, (k * 11 + 5) % 24, (k * 17 + 1) % 24, 3 + s % 4) for k, s in mine]
        wanted += _plain(grains, vol_id)
    assert sorted(map(tuple, table.collect())) == wanted
