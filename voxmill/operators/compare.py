"""Result rows of many crops and methods, and statistics over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles
from ..params import AVERAGED_METRICS, TOTAL_METRICS
from ..session import lookup_join, union_all

DETAIL = (
    "scan", "crop_id", "method", "gt_valid", "pred_labels", "precision050", "recall050", "f1050",
    "fp050", "fn050", "overseg_ratio",
)


def crop_summary(metrics: DataFrame, volumes: DataFrame, first_threshold: float) -> DataFrame:
    """The row of the first listed threshold per volume, renamed.

    ``volumes`` maps ``vol_id`` to ``scan, crop_id, method``.
    """
    rows = lookup_join(metrics.filter(F.col("threshold") == float(first_threshold)), volumes, ["vol_id"])
    return rows.select(
        "scan", "crop_id", "method", "gt_valid",
        F.col("pred_total").alias("pred_labels"),
        "pred_eval",
        F.col("pred_ignored_border").alias("pred_ignored"),
        F.col("precision").alias("precision050"),
        F.col("recall").alias("recall050"),
        F.col("f1").alias("f1050"),
        F.col("fp").alias("fp050"),
        F.col("fn").alias("fn050"),
        F.col("overseg_ratio_pred_eval_gt").alias("overseg_ratio"),
    )


def detail(*scans: DataFrame) -> DataFrame:
    return union_all(*[s.select(*DETAIL) for s in scans])


def _mean(value: str) -> Column:
    """Mean from the exact sum of the values as decimals, the same in any order; of values beyond decimals, as doubles."""
    exact = F.expr(f"try_cast({value} as decimal(38, 18))")
    whole = F.count(exact) == F.count(value)
    return F.when(whole, F.coalesce(F.try_sum(exact).cast("double") / F.count(value), F.avg(value))).otherwise(F.avg(value))


def _six_decimals(values: pd.Series) -> pd.Series:
    """As C prints them: the binary value rounded to nearest, where Java rounds its shortest decimal form."""
    return values.map("{:.6f}".format)


def grouped_statistics(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Mean, median, min, max, sample deviation of each metric, over ALL and per scan."""
    listed = rows.filter(F.col("method").isin(*methods))
    groups = F.explode(F.array(F.lit("ALL"), F.col("scan"))).alias("group")
    metrics = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in AVERAGED_METRICS])
    ).alias("e")
    long = listed.select("method", groups, metrics).select("group", "method", "e.metric", "e.v")
    keys = ["group", "method", "metric"]
    base = long.groupBy(*keys).agg(
        _mean("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
    )
    return base.join(exact_quantiles(long, keys, "v", [50.0], ["median"]), keys).select(
        *keys, "mean", "median", "min", "max", "std"
    )


def totals(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Summed false positives and negatives as rows of the same long table."""
    listed = rows.filter(F.col("method").isin(*methods))
    groups = F.explode(F.array(F.lit("ALL"), F.col("scan"))).alias("group")
    sums = listed.select("method", groups, "fp050", "fn050").groupBy("group", "method").agg(
        F.sum("fp050").alias("total_fp"), F.sum("fn050").alias("total_fn")
    )
    both = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("mean")) for m in TOTAL_METRICS])
    ).alias("e")
    blank = [F.lit(None).cast("double").alias(c) for c in ("median", "min", "max", "std")]
    return sums.select("group", "method", both).select("group", "method", "e.metric", "e.mean", *blank)


def statistics(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    return union_all(grouped_statistics(rows, methods), totals(rows, methods))


def formatted(stats: DataFrame) -> DataFrame:
    """Text form: six decimals, whole numbers for totals, blanks where empty."""
    total = F.col("metric").isin(*TOTAL_METRICS)
    decimals = F.pandas_udf(_six_decimals, T.StringType())
    shown = [
        F.when(F.col(c).isNull(), "")
        .when(total, F.col(c).cast("long").cast("string"))
        .otherwise(decimals(F.col(c).cast("double")))
        .alias(c)
        for c in ("mean", "median", "min", "max", "std")
    ]
    return stats.select("group", "method", "metric", *shown)


def method_table(stats: DataFrame) -> DataFrame:
    """One row per method over ALL: four means and the two totals."""
    names = [*AVERAGED_METRICS, *TOTAL_METRICS]
    wide = stats.filter(F.col("group") == "ALL").groupBy("method").pivot("metric", names).agg(F.first("mean"))
    return wide.select("method", *AVERAGED_METRICS, *[F.col(t).cast("long").alias(t) for t in TOTAL_METRICS])
