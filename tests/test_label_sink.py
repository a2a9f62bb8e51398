"""Labels are written by the task that reads them."""

import os
import tempfile

from voxmill.sources import tables


def test_labels_need_no_folder_per_volume(spark):
    rows = [(v, z, 0, 0, 70_000 if v == 7 else v + 1) for v in range(30) for z in (0, 70)]
    path = f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/labels"
    tables.write_labels(spark.createDataFrame(rows, "vol_id int, z int, y int, x int, label int").repartition(2), path)
    back = tables.read_labels(spark, path).select("vol_id", "z", "y", "x", "label", "stored_bits").collect()
    assert sorted(map(tuple, back)) == sorted((*r, 32 if r[0] == 7 else 16) for r in rows)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) <= 4
