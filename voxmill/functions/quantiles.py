"""Exact linearly interpolated quantiles per group.

A percentile aggregate keeps every distinct value of a group in one buffer.
Instead, cells are counted (partial aggregates before the shuffle), the cells
holding the wanted ranks are found from their running totals, and only those
are split further until few enough values are left to order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import bricks
from ..session import discard, lookup_join, store

CELLS = 1024
#: Most rows with differing values of one cell that are ordered inside one window.
FINAL_ROWS = 10_000
#: A pass narrows a cell a thousandfold; doubles cannot need more.
MOST_PASSES = 220
_ODD = "quantiles need finite values"
_TOTALS = pa.schema([("vol_id", pa.int32()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("_n", pa.int64()), ("_lo", pa.float64())])


def _ranks(totals: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Two neighbouring 0-based ranks per group and probability."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    at = totals.select(*by, "n", "lo", "hi", F.posexplode(wanted).alias("i", "p"))
    at = at.withColumn("pos", F.col("p") / 100 * (F.col("n") - 1))
    at = at.withColumn("t", F.col("pos") - F.floor("pos"))
    ends = F.array(F.floor("pos"), F.ceil("pos"))
    return at.select(*by, "i", "t", "lo", "hi", "n", F.posexplode(ends).alias("end", "rank"))


def _locate(counts: DataFrame, by: list[str], cell: str, wanted: DataFrame) -> DataFrame:
    """The cell of each wanted rank; ``rank`` becomes relative to that cell."""
    order = W.partitionBy(*by).orderBy(cell).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = counts.withColumn("_upto", F.sum("n").over(order))
    hit = running.join(wanted.drop("n"), by).filter("rank >= _upto - n and rank < _upto")
    return hit.withColumn("rank", F.col("rank") - (F.col("_upto") - F.col("n")))


class _Rows:
    """One value a row."""

    def __init__(self, df: DataFrame, by: list[str], value: str):
        v = F.col(value).cast("double")
        odd = F.isnan(v) | (F.abs(v) == float("inf"))
        v = F.when(odd, F.raise_error(F.lit(_ODD)).cast("double")).otherwise(v)
        self.by, self.data = by, df.select(*by, v.alias("v")).filter("v is not null")

    def totals(self) -> DataFrame:
        above = F.when(F.col("v") > 0, F.col("v"))
        return self.data.groupBy(*self.by).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.count(above).alias("_n"), F.min(above).alias("_lo"),
        )

    def _inside(self, wanted: DataFrame) -> DataFrame:
        near = lookup_join(self.data, _cells_of(wanted, self.by), self.by).select(*self.by, "v", F.explode("cells").alias("c"))
        return near.filter("v >= c.lo and v <= c.hi").select(*self.by, "v", "c.lo", "c.hi")

    def cells(self, wanted: DataFrame) -> DataFrame:
        width = (F.col("hi") - F.col("lo")) / CELLS
        at = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0))
        counted = self._inside(wanted).withColumn("cell", F.least(at, F.lit(CELLS - 1)))
        return counted.groupBy(*self.by, "lo", "hi", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax")
        )

    def values(self, wanted: DataFrame) -> DataFrame:
        return self._inside(wanted).groupBy(*self.by, "lo", "hi", "v").agg(F.count(F.lit(1)).alias("n"))


class _Bricks:
    """Arrays of values: a task counts those of a batch, and only the counts are shuffled."""

    by = ["vol_id"]

    def __init__(self, rows: DataFrame, value: str):
        self.data = rows.select("vol_id", F.col(value).alias("v"))

    def totals(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for vol_id, _, values in bricks.per_volume(batch):
                    v = _finite(values)
                    if len(v):
                        above = v[v > 0]
                        yield pa.RecordBatch.from_pylist([{
                            "vol_id": vol_id, "n": len(v), "lo": float(v.min()), "hi": float(v.max()), "_n": len(above),
                            "_lo": float(above.min()) if len(above) else None}], schema=_TOTALS)

        parts = self.data.mapInArrow(run, "vol_id int, n long, lo double, hi double, _n long, _lo double")
        return parts.groupBy("vol_id").agg(*(f(c).alias(c) for c, f in (("n", F.sum), ("lo", F.min), ("hi", F.max), ("_n", F.sum), ("_lo", F.min))))

    def _counted(self, wanted: DataFrame, split: bool) -> DataFrame:
        """Counts per cell of the wanted ones, or per value in them."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for vol_id, row, values in bricks.per_volume(batch):
                    v = np.sort(_finite(values))
                    for cell in batch.column(2)[row].as_py():
                        lo, hi = cell["lo"], cell["hi"]
                        own = v[np.searchsorted(v, lo, "left"):np.searchsorted(v, hi, "right")]
                        if not len(own):
                            continue
                        width = (hi - lo) / CELLS
                        key = np.minimum(np.floor((own - lo) / width), CELLS - 1) if split and width > 0 else np.zeros(len(own)) if split else own
                        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                        ends = np.append(first[1:], len(own)) - 1
                        k = len(first)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(k, vol_id, np.int32)), pa.array(np.full(k, lo)), pa.array(np.full(k, hi)), pa.array(key[first].astype(np.int64) if split else np.zeros(k, np.int64)),
                            pa.array(ends - first + 1), pa.array(own[first]), pa.array(own[ends])], ["vol_id", "lo", "hi", "cell", "n", "vmin", "vmax"])

        met = lookup_join(self.data, _cells_of(wanted, self.by), self.by).select("vol_id", "v", "cells")
        return met.mapInArrow(run, "vol_id int, lo double, hi double, cell long, n long, vmin double, vmax double")

    def cells(self, wanted: DataFrame) -> DataFrame:
        return self._counted(wanted, True).groupBy("vol_id", "lo", "hi", "cell").agg(
            F.sum("n").alias("n"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))

    def values(self, wanted: DataFrame) -> DataFrame:
        return self._counted(wanted, False).groupBy("vol_id", "lo", "hi", F.col("vmin").alias("v")).agg(F.sum("n").alias("n"))


def _finite(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.float64)
    if not np.isfinite(v).all():
        raise ValueError(_ODD)
    return v


def _cells_of(wanted: DataFrame, by: list[str]) -> DataFrame:
    """The wanted cells of each group, at most two per probability."""
    return wanted.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi")).alias("cells"))


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], names: list[str], positive: bool = False
) -> DataFrame:
    """One row per group with one column per probability (in percent).

    ``positive`` looks at values above zero only, in groups that have any.
    """
    return _quantiles(_Rows(df, by, value), probs, names, positive)


def brick_quantiles(rows: DataFrame, value: str, probs: list[float], names: list[str], positive: bool = False) -> DataFrame:
    """The same per volume for an array column of brick rows, which are not unpacked."""
    return _quantiles(_Bricks(rows, value), probs, names, positive)


def _quantiles(data: _Rows | _Bricks, probs: list[float], names: list[str], positive: bool) -> DataFrame:
    by = data.by
    totals = data.totals()
    if positive:
        some = F.col("_n") > 0
        totals = totals.withColumn("n", F.when(some, F.col("_n")).otherwise(F.col("n"))).withColumn(
            "lo", F.when(some, F.col("_lo")).otherwise(F.col("lo"))
        )
    wanted = store(_ranks(totals, by, probs), "ranks")

    group = [*by, "lo", "hi"]
    for _ in range(MOST_PASSES):
        if wanted.filter((F.col("n") > FINAL_ROWS) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        found = _locate(data.cells(wanted), group, "cell", wanted)
        before, wanted = wanted, store(
            found.select(
                *by, "i", "t", F.col("vmin").alias("lo"), F.col("vmax").alias("hi"), "n", "end", "rank"
            ),
            "ranks",
        )
        discard(before)
    else:
        raise RuntimeError("quantile cells made no progress")

    ends = _locate(data.values(wanted), group, "v", wanted)
    both = ends.groupBy(*by, "i").agg(
        F.max("t").alias("t"),
        F.max(F.when(F.col("end") == 0, F.col("v"))).alias("a"),
        F.max(F.when(F.col("end") == 1, F.col("v"))).alias("b"),
    )
    value_at = F.col("a") + (F.col("b") - F.col("a")) * F.col("t")
    picks = [F.max(F.when(F.col("i") == i, value_at)).alias(name) for i, name in enumerate(names)]
    return both.groupBy(*by).agg(*picks)


def histogram_quantiles(hist: DataFrame, by: list[str], value: str, probs: list[float], names: list[str]) -> DataFrame:
    """The same from a histogram ``(by, value, n)`` over a bounded integer range."""
    order = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = hist.withColumn("_upto", F.sum("n").over(order)).withColumn(
        "_total", F.sum("n").over(W.partitionBy(*by))
    )

    def at(rank):
        return F.min(F.when(F.col("_upto") > rank, F.col(value))).cast("double")

    picks = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) / 100 * (F.col("_total") - 1)
        a, b, t = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
        picks.append((a + (b - a) * t).alias(name))
    return upto.groupBy(*by).agg(*picks)
