import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers as H
from voxmill import session
from voxmill.functions import bricks
from voxmill.functions import quantiles as Q
from voxmill.operators import components as C
from voxmill.operators import evaluate, features
from voxmill.operators import intensity as I
from voxmill.params import Scoring
from voxmill.sources import tables


def _folder(name):
    return f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{name}"


def test_scan_of_channels_slices_and_csv(spark):
    path = _folder("v")
    rows = spark.createDataFrame([(1, 0, 0, c, 5 + c) for c in range(3)], "vol_id int, y int, x int, c int, gray int")
    rows.write.parquet(path)
    read = tables.read_voxels(spark, path, "gray", columns=("vol_id", "y", "x", "c"))
    assert [tuple(r) for r in read.collect()] == [(1, 0, 0, 0, 5)]
    with pytest.raises(ValueError):
        tables.read_voxels(spark, path, "gray", columns=("vol_id", "y", "x", "c"), strict=True)
    text = _folder("csv")
    read.write.option("header", True).csv(text)
    assert tables.read_voxels(spark, text, "gray", fmt="csv").first().gray == 5


def test_crop_ends_at_the_volume_edge(spark):
    gray = np.arange(4 * 5 * 70).reshape(4, 5, 70)
    voxels = H.voxel_table(spark, {1: gray}, "gray", keep_zero=True)
    boxes = spark.createDataFrame([("c", 60, 2, 1, 20)], "crop_id string, x int, y int, z int, size int")
    got = tables.cut_crops(voxels, boxes).collect()
    want = gray[1:, 2:, 60:]
    assert len(got) == want.size and all(want[r.z, r.y, r.x] == r.gray for r in got)


def test_labels_round_trip_and_width(spark):
    labels = spark.createDataFrame([(1, 0, 0, 0, 7), (1, 0, 0, 1, 0), (2, 0, 0, 0, 70000), (3, 0, 0, 0, 65535)],
                                   "vol_id int, z int, y int, x int, label long")
    assert {r.vol_id: r.stored_bits for r in tables.label_width(labels).collect()} == {1: 16, 2: 32, 3: 16}
    path = _folder("labels")
    tables.write_labels(labels, path)
    assert {(r.vol_id, r.label, r.stored_bits) for r in tables.read_labels(spark, path).collect()} == {(1, 7, 16), (2, 70000, 32), (3, 65535, 16)}
    assert dict(spark.read.parquet(f"{path}/bits=16").dtypes)["label"] == "smallint"


def test_shape_mismatch_is_refused(spark):
    a, b = H.catalog(spark, {1: np.zeros((2, 3, 4))}), H.catalog(spark, {1: np.zeros((2, 3, 5))})
    tables.require_same_shape(a, a)
    with pytest.raises(ValueError):
        tables.require_same_shape(a, b)


def test_results_from_text(spark):
    path = _folder("results")
    header = ("crop_id", "method", *tables.RESULT_COUNTS, *tables.RESULT_RATIOS)
    rows = spark.createDataFrame([("c", "m", "5.0", "6", "7.0", "8", "0.5", "1", "0.25", "2")], list(header))
    tables.write_report(rows, path)
    row = tables.read_results(spark, path, "s").first()
    assert (row.scan, row.gt_valid, row.fn050, row.f1050) == ("s", 5, 8, 0.25)


def test_constant_and_empty_volumes(spark):
    voxels = H.voxel_table(spark, {1: np.full((2, 2, 2), 9), 2: np.zeros((2, 2, 2), int)}, "gray", keep_zero=True)
    limits = {r.vol_id: (r.threshold, r.otsu) for r in I.dark_threshold(voxels, value="gray").collect()}
    assert limits == {1: (None, None), 2: (None, None)}
    levels = {r.vol_id: r.otsu for r in I.otsu(I.histogram(voxels), constant_value=True).collect()}
    assert levels == {1: 9, 2: 0}
    scaled = {(r.vol_id, r.gray) for r in I.rescale(voxels).collect()}
    assert scaled == {(1, 0), (2, 0)}


def test_lookup_join_without_broadcast_gives_the_same(spark, monkeypatch):
    big = spark.range(500).withColumn("k", (F.col("id") % 7).cast("int"))
    small = spark.createDataFrame([(k, k * k) for k in range(6)], "k int, v int")
    want = sorted(map(tuple, session.lookup_join(big, small, ["k"], "left").collect()), key=repr)
    for limit in (100, 2):
        monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
        got = sorted(map(tuple, session.lookup_join(big, small, ["k"], "left").collect()), key=repr)
        assert got == want


def test_lookup_join_reads_a_table_that_was_overwritten(spark, tmp_path):
    path, big = str(tmp_path / "small"), spark.range(2).withColumn("k", F.lit(1))
    for value in (10, 99):
        spark.createDataFrame([(1, value)], "k int, v int").write.mode("overwrite").parquet(path)
        assert {r.v for r in session.lookup_join(big, spark.read.parquet(path), ["k"]).collect()} == {value}


def test_stored_tables_can_be_discarded(spark):
    stored = session.store(spark.range(3), "few")
    assert stored.count() == 3 and os.path.isdir(stored._stored_at.removeprefix("file:"))
    session.discard(stored, None, spark.range(1))
    assert not os.path.exists(stored._stored_at.removeprefix("file:"))


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.workspace(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.workspace(Session)


def test_partition_count_does_not_matter(spark):
    mask = H.voxel_table(spark, {1: np.random.default_rng(6).random((8, 8, 8)) < 0.5}).drop("value")
    found = []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, C.label(mask, 2, 3).collect())))
    assert found[0] == found[1]


def test_gray_that_is_not_8bit_is_rescaled_or_refused(spark):
    rng = np.random.default_rng(8)
    wide = H.voxel_table(spark, {1: rng.integers(1, 4000, (4, 5, 6))}, "gray", keep_zero=True)
    with pytest.raises(Exception, match="8-bit"):
        I.otsu(I.histogram(wide)).collect()
    eight = I.to_8bit(wide, "uint16")
    low, high = eight.agg(F.min("gray"), F.max("gray")).first()
    assert (low, high) == (0, 255) and I.otsu(I.histogram(eight)).count() == 1
    huge = wide.withColumn("gray", F.col("gray").cast("long") * 100_000)
    got = I.percentiles(huge, "gray", [25.0], ["q"]).first().q
    values = [r.gray for r in huge.collect()]
    assert np.isclose(got, np.percentile(values, 25))


def test_values_that_are_not_finite_are_refused(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, float("inf"))], "g int, v double")
    with pytest.raises(Exception, match="finite"):
        Q.exact_quantiles(rows, ["g"], "v", [50.0], ["m"]).collect()


def test_a_missing_voxel_is_an_error(spark):
    voxels = H.voxel_table(spark, {1: np.ones((2, 2, 5), int)}, "gray", keep_zero=True).filter("x <> 2")
    for pack in (lambda v: bricks.from_voxels(v, "gray"), lambda v: features.pack_lines(v, "gray")):
        with pytest.raises(Exception, match="missing"):
            pack(voxels).collect()


def test_loops_without_progress_end(spark):
    with pytest.raises(RuntimeError, match="cycle"):
        C.shorten(session.store(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "vol_id int, node long, root long"), "loop"))


def test_volumes_without_labels_have_rows(spark):
    table = spark.createDataFrame([(1, 5, 7, 9, 0), (3, 0, 2, 4, 0)], "vol_id int, gt_id int, pred_id int, n long, border long")
    volumes = spark.createDataFrame([(1,), (2,), (3,)], "vol_id int")
    scoring = Scoring(min_gt_area=1, thresholds=(0.5,))
    rows = {r.vol_id: r for r in evaluate.threshold_metrics(table, scoring, volumes=volumes).collect()}
    assert set(rows) == {1, 2, 3} and rows[1].tp == 1 and rows[2].f1 == 0 and rows[3].fp == 1
    recall = {r.vol_id: r.gt_object_recall for r in evaluate.object_recall(evaluate.best_per_true(table, scoring), scoring, volumes).collect()}
    assert recall == {1: 1.0, 2: 0.0, 3: 0.0}
    assert evaluate.summary(table, None, scoring, volumes).groupBy("vol_id").count().select("count").distinct().count() == 1
