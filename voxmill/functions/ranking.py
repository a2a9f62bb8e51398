"""Consecutive numbers per volume without sorting a volume in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import lookup_join, shuffled, store


def number_by_bucket(df: DataFrame, order: str, bucket: Column, name: str) -> DataFrame:
    """Number the rows of each volume 1..n by the unique column ``order``.

    ``bucket`` must be a non-decreasing function of ``order`` with bounded
    buckets; only the bucket totals of a volume meet in one window.
    """
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy("vol_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("vol_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "vol_id", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy("vol_id", "_bucket").orderBy(order)
    numbered = df.withColumn("_row", F.row_number().over(inside))
    return (
        numbered.join(shuffled(starts), ["vol_id", "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_bucket", "_row", "_start")
    )


def number_in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each volume 1..n in any total order.

    A range sort spreads a volume over partitions; the sorted table is stored
    so that partition numbers stay fixed, then each partition adds the row
    count of the earlier ones.
    """
    ranged = df.repartitionByRange(F.col("vol_id"), *order)
    ranged = store(ranged.withColumn("_part", F.spark_partition_id()), "ranked")
    totals = ranged.groupBy("vol_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("vol_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "vol_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy("vol_id", "_part").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(inside))
    return (
        lookup_join(numbered, starts, ["vol_id", "_part"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )
