"""Percentiles, rescaling, statistics and thresholds of gray volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import bricks
from ..functions.quantiles import exact_quantiles, histogram_quantiles
from ..params import Dark
from ..session import lookup_join


#: Range of whole numbers that is counted level by level.
LEVELS = 65_535


def histogram(voxels: DataFrame, value: str = "gray") -> DataFrame:
    """``(vol_id, value, n)`` of voxels or of brick rows: one pass, counted before the shuffle."""
    if "xb" in voxels.columns:
        return bricks.histogram(voxels, value)
    return voxels.groupBy("vol_id", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _eight_bit(value) -> F.Column:
    """The value, or an error if it is not an 8-bit level."""
    return F.when(value.between(0, 255), value).otherwise(F.raise_error(F.lit("8-bit levels expected: rescale first")).cast("int"))


def _foreground(values: DataFrame, value: str) -> DataFrame:
    """Rows above zero, or all rows of a volume without any."""
    some = values.groupBy("vol_id").agg(F.max(F.col(value) > 0).alias("_some"))
    return lookup_join(values, some, ["vol_id"]).filter(f"{value} > 0 or not _some").drop("_some")


def percentiles(voxels: DataFrame, value: str, probs: list[float], names: list[str]) -> DataFrame:
    """Exact percentiles of the non-zero values of each volume.

    Whole numbers up to ``LEVELS`` are counted level by level; anything wider goes
    through cells, so that no task orders all distinct values of a volume.
    """
    whole = isinstance(voxels.schema[value].dataType, T.IntegralType)
    if whole:
        low, high = voxels.agg(F.min(value), F.max(value)).first()
        whole = low is None or high - low <= LEVELS
    if whole:
        hist = _foreground(histogram(voxels, value), "value")
        return histogram_quantiles(hist, ["vol_id"], "value", probs, names)
    return exact_quantiles(voxels, ["vol_id"], value, probs, names, positive=True)


def stretch(ends: DataFrame) -> DataFrame:
    """``_lo`` and ``_range`` in float32 of the two percentiles ``_lo`` and ``_hi``; an empty range counts as 1."""
    ends = ends.withColumn("_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1).otherwise(F.col("_hi")))
    return ends.select(
        "vol_id", F.col("_lo").cast("float").alias("_lo"), (F.col("_hi") - F.col("_lo")).cast("float").alias("_range")
    )


def rescale(voxels: DataFrame, value: str = "gray", p_low: float = 0.5, p_high: float = 99.5) -> DataFrame:
    """Stretch between two percentiles to 0..255, truncated, in float32."""
    ends = percentiles(voxels, value, [p_low, p_high], ["_lo", "_hi"])
    ends = stretch(ends)
    scaled = (F.col(value).cast("float") - F.col("_lo")) * F.lit(255.0).cast("float")
    # float / float would be widened to double, hence the cast back
    scaled = (scaled / F.col("_range")).cast("float")
    bounded = F.least(F.greatest(scaled, F.lit(0.0).cast("float")), F.lit(255.0).cast("float"))
    rest = [c for c in voxels.columns if c != value]
    return lookup_join(voxels, ends, ["vol_id"]).select(*rest, bounded.cast("int").alias(value))


def to_8bit(voxels: DataFrame, dtype: str = "uint8", value: str = "gray") -> DataFrame:
    """8-bit volumes pass unchanged, all others are rescaled: the entry of every job."""
    return voxels if dtype == "uint8" else rescale(voxels, value)


def statistics(voxels: DataFrame, value: str = "gray") -> DataFrame:
    return voxels.groupBy("vol_id").agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )


def otsu(hist: DataFrame, constant_value: bool = False) -> DataFrame:
    """First 8-bit level with the largest between-class variance per volume.

    A volume with a single gray level has none: null, or that level itself
    with ``constant_value`` (the convention of the foreground threshold).
    """
    hist = hist.withColumn("value", _eight_bit(F.col("value")))
    upto = W.partitionBy("vol_id").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("vol_id")
    weight = F.col("n") * F.col("value")
    sums = hist.select(
        "vol_id",
        "value",
        F.sum("n").over(upto).alias("below"),
        F.sum(weight).over(upto).alias("mass"),
        F.sum("n").over(whole).alias("total"),
        F.sum(weight).over(whole).alias("total_mass"),
    )
    share, mean = F.col("below") / F.col("total"), F.col("mass") / F.col("total")
    spread = share * (1 - share)
    gap = F.col("total_mass") / F.col("total") * share - mean
    sigma = F.when(spread > 1e-12, gap * gap / spread)
    best = F.max(F.when(sigma.isNotNull(), F.struct(sigma.alias("s"), (-F.col("value")).alias("down"))))
    level = -best["down"]
    if constant_value:
        level = F.coalesce(level, F.max("value"))
    return sums.groupBy("vol_id").agg(level.cast("int").alias("otsu"))


def dark_threshold(voxels: DataFrame, params: Dark = Dark(), value: str = "flat") -> DataFrame:
    """``(vol_id, threshold, otsu, pval)``: explicit level, or the least of three."""
    hist = histogram(voxels, value)
    pval = histogram_quantiles(_foreground(hist, "value"), ["vol_id"], "value", [params.percentile], ["pval"])
    both = otsu(hist).join(pval, "vol_id")
    if params.threshold >= 0:
        level = F.lit(int(params.threshold))
    else:
        least = F.least(F.col("otsu") + params.otsu_offset, F.col("pval"), F.lit(params.threshold_max))
        least = F.when(F.col("otsu").isNotNull(), least)
        level = F.least(F.greatest(least, F.lit(1)), F.lit(255)).cast("int")
        level = F.when(F.col("otsu").isNotNull(), level)
    return both.select("vol_id", level.alias("threshold"), "otsu", "pval")


def dark_mask(voxels: DataFrame, thresholds: DataFrame, value: str = "flat", whole: bool = True) -> DataFrame:
    """Voxels at most at the threshold; of brick rows, their runs (cut at bricks unless ``whole``).  A volume without threshold has none."""
    limit = thresholds.select("vol_id", "threshold").filter("threshold is not null")
    met = lookup_join(voxels, limit, ["vol_id"])
    if "xb" in voxels.columns:
        return bricks.runs_where(met, value, "threshold", np.less_equal, whole)
    return met.filter(F.col(value) <= F.col("threshold")).select("vol_id", "z", "y", "x")


def foreground_threshold(voxels: DataFrame, offset: float, value: str = "gray") -> DataFrame:
    level = otsu(histogram(voxels, value), constant_value=True)
    bounded = F.least(F.greatest(F.col("otsu") + F.lit(offset), F.lit(0)), F.lit(255))
    return level.select("vol_id", "otsu", bounded.cast("int").alias("threshold"))


def foreground_mask(voxels: DataFrame, offset: float, value: str = "gray") -> DataFrame:
    """Voxels at least at the threshold; of brick rows, their runs."""
    limit = foreground_threshold(voxels, offset, value).select("vol_id", "threshold").filter("threshold is not null")
    met = lookup_join(voxels, limit, ["vol_id"])
    if "xb" in voxels.columns:
        return bricks.runs_where(met, value, "threshold", np.greater_equal)
    return met.filter(F.col(value) >= F.col("threshold")).select("vol_id", "z", "y", "x")
