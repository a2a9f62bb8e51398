"""Reading, shaping and writing volumes, catalogs, crops and reports."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import lookup_join

TILE = 64
#: Most boxes that are put into one filter.
LISTED_BOXES = 64
RESULT_COUNTS = ("gt_valid", "pred_labels", "fp050", "fn050")
RESULT_RATIOS = ("precision050", "recall050", "f1050", "overseg_ratio")


def read_voxels(spark: SparkSession, path: str, value: str, kind: str = "int", fmt: str = "parquet",
                columns: tuple[str, ...] = ("vol_id", "z", "y", "x"), strict: bool = False) -> DataFrame:
    """Scan a voxel table with a declared schema and bring it to ``vol_id, z, y, x``.

    ``columns`` names the coordinates present, ``c`` for a channel.  Only the
    first channel is kept.  Volumes without ``z`` are one slice, which
    ``strict`` refuses.
    """
    reader = spark.read.schema(", ".join([*(f"{c} int" for c in columns), f"{value} {kind}"]))
    rows = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    return normalise(rows, value, strict)


def normalise(rows: DataFrame, value: str, strict: bool = False) -> DataFrame:
    missing = {"vol_id", "y", "x", value} - set(rows.columns)
    if missing or (strict and "z" not in rows.columns):
        raise ValueError(f"not a 3D volume table: {rows.columns}")
    if "c" in rows.columns:
        rows = rows.filter("c = 0")
    if "z" not in rows.columns:
        rows = rows.withColumn("z", F.lit(0))
    return rows.select("vol_id", "z", "y", "x", value)


def catalog_of(voxels: DataFrame) -> DataFrame:
    """Shape of dense volumes; sparse label tables need a declared catalog."""
    return voxels.groupBy("vol_id").agg(
        (F.max("z") + 1).alias("depth"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")
    )


def shape_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Volumes of two catalogs whose shapes differ, or that one of them lacks."""
    b = right.select("vol_id", *[F.col(c).alias("other_" + c) for c in ("depth", "height", "width")])
    same = [F.col(c).eqNullSafe(F.col("other_" + c)) for c in ("depth", "height", "width")]
    return left.select("vol_id", "depth", "height", "width").join(b, "vol_id", "full").filter(
        ~(same[0] & same[1] & same[2])
    )


def require_same_shape(left: DataFrame, right: DataFrame) -> None:
    wrong = shape_mismatches(left, right).limit(5).collect()
    if wrong:
        raise ValueError(f"shape mismatch: {wrong}")


def write_voxels(voxels: DataFrame, path: str) -> None:
    """Write a voxel table in the order of volume and tile.

    The rows of a tile lie together, so the files' and row groups' least and largest
    coordinates tell which of them a box needs.
    """
    tiles = [F.floor(F.col(c) / TILE).alias("t" + c) for c in "zyx"]
    tiled = voxels.select("*", *tiles)
    ordered = tiled.repartitionByRange("vol_id", "tz", "ty", "tx").sortWithinPartitions("vol_id", "tz", "ty", "tx", "z", "y", "x")
    ordered.drop("tz", "ty", "tx").write.parquet(path)


def _in_boxes(boxes: list) -> Column:
    """In one of the listed boxes, by the stored columns alone: the scan can skip what lies outside."""
    def inside(box) -> Column:
        return reduce(and_, [(F.col(c) >= box[c]) & (F.col(c) <= box[c] + box["size"] - 1) for c in "zyx"])

    return reduce(or_, map(inside, boxes), F.lit(False))


def cut_crops(voxels: DataFrame, crops: DataFrame) -> DataFrame:
    """Voxels of each box, moved to the origin; boxes end at the volume edge.

    Up to ``LISTED_BOXES`` boxes are also a filter on the coordinates, which reaches the
    scan of the voxels; the result is the same without it.  Boxes are listed by the tiles
    they reach, so the range condition rides on an equi-join: a broadcast for few boxes,
    else by shuffle with salted tiles.
    """
    def reach(c: str):
        return F.explode(
            F.sequence(F.floor(F.col("c" + c) / TILE).cast("int"), F.floor((F.col("c" + c) + F.col("size") - 1) / TILE).cast("int"))
        )

    listed = crops.select("z", "y", "x", "size").filter("size > 0").distinct().limit(LISTED_BOXES + 1).collect()
    if len(listed) <= LISTED_BOXES:
        voxels = voxels.filter(_in_boxes(listed))
    boxes = crops.select("crop_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), "size").filter("size > 0")
    for c in "zyx":
        boxes = boxes.withColumn("t" + c, reach(c))
    tiled = voxels.withColumns({"t" + c: F.floor(F.col(c) / TILE).cast("int") for c in "zyx"})
    met = lookup_join(tiled, boxes, ["tz", "ty", "tx"])
    for c in "zyx":
        met = met.filter((F.col(c) >= F.col("c" + c)) & (F.col(c) < F.col("c" + c) + F.col("size")))
    moved = {c: F.col(c) - F.col("c" + c) for c in "zyx"}
    return met.select("crop_id", "vol_id", *[moved.get(c, F.col(c)).alias(c) for c in voxels.columns if c != "vol_id"])


def label_width(labels: DataFrame, label: str = "label") -> DataFrame:
    """Narrowest stored type per volume: 16 bits up to 65535, else 32."""
    top = labels.groupBy("vol_id").agg(F.max(label).alias("max_label"))
    return top.withColumn("stored_bits", F.when(F.col("max_label") <= 65535, 16).otherwise(32))


def write_labels(labels: DataFrame, path: str, label: str = "label") -> None:
    """Write labels above zero, each volume in its ``label_width``.

    16-bit labels lie in ``bits=16`` as shorts, those from 32768 on less 65536 (Spark
    has no unsigned type); the others in ``bits=32``.  Every task writes what it reads, so
    no voxel is shuffled and files grow with the data, not with the number of volumes;
    where the input is ordered by volume, the files' least and largest ``vol_id`` tell which one a volume needs.
    """
    some = labels.filter(F.col(label) > 0)
    # Only the volumes with wide labels are looked up: few, however many volumes there are.
    large = label_width(some, label).filter("stored_bits = 32").select("vol_id", "stored_bits")
    wide = lookup_join(some, large, ["vol_id"], "left").fillna(16, ["stored_bits"])
    short = F.when(F.col(label) > 32767, F.col(label) - 65536).otherwise(F.col(label)).cast("short")
    for bits, value in ((16, short), (32, F.col(label).cast("int"))):
        rows = wide.filter(F.col("stored_bits") == bits).withColumn(label, value)
        rows.drop("stored_bits").write.parquet(f"{path}/bits={bits}")


def read_labels(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """Labels as written, with ``stored_bits`` from the folder they lie in."""
    narrow = spark.read.schema(f"z int, y int, x int, {label} short, vol_id int").parquet(f"{path}/bits=16")
    wide = spark.read.schema(f"z int, y int, x int, {label} int, vol_id int").parquet(f"{path}/bits=32")
    value = F.col(label).cast("int")
    narrow = narrow.withColumn(label, F.when(value < 0, value + 65536).otherwise(value)).withColumn("stored_bits", F.lit(16))
    return narrow.unionByName(wide.withColumn("stored_bits", F.lit(32)))


def write_mask(mask: DataFrame, path: str) -> None:
    """Write a mask as 0/255 gray, set voxels only."""
    rows = mask.withColumn("value", F.lit(255).cast("short"))
    rows.repartition("vol_id", F.floor(F.col("z") / TILE)).write.partitionBy("vol_id").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, scan: str | None = None) -> DataFrame:
    """Result rows from CSV text; ``scan`` names the scan when no column does."""
    rows = spark.read.option("header", True).csv(path)
    return cast_results(rows, scan)


def cast_results(rows: DataFrame, scan: str | None = None) -> DataFrame:
    name = F.lit(scan) if scan is not None else F.col("scan")
    counts = [F.col(c).cast("double").cast("int").alias(c) for c in RESULT_COUNTS]
    ratios = [F.col(c).cast("double").alias(c) for c in RESULT_RATIOS]
    cast = rows.select(name.alias("scan"), "crop_id", "method", *counts, *ratios)
    return cast.select(
        "scan", "crop_id", "method", "gt_valid", "pred_labels", "precision050", "recall050", "f1050",
        "fp050", "fn050", "overseg_ratio",
    )
