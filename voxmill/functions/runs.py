"""Masks and labels as runs along x: ``(vol_id, z, y, x0, x1)`` per line.

A grain of radius r holds about r^3 voxels but only r^2 runs, so set algebra
and morphology shuffle far fewer rows than voxel tables would.  Every window
below is partitioned by one line, whose length is bounded by the volume width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import lookup_join, union_all
from .numeric import ascending, touching

LINE = ["vol_id", "z", "y"]
RUN = [*LINE, "x0", "x1"]
#: Width of the stretches of a line within which runs are joined.
BLOCK = 64


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The voxels ``(vol_id, z, y, x, ...)`` of each batch as runs; the other columns are constant per run."""
    for batch in batches:
        keys = [pc.fill_null(batch.column(k), -(2**31)).to_numpy(zero_copy_only=False) for k in range(4)]
        if not ascending(keys):
            order = np.lexsort(keys[::-1])
            batch, keys = batch.take(pa.array(order)), [k[order] for k in keys]
        rest = batch.columns[4:]
        codes = [c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in rest]
        first = touching([*keys[:3], *codes], keys[3], keys[3])
        at, end = pa.array(first), pa.array(np.append(first[1:], len(batch))[:len(first)] - 1)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(at) for k in range(4)), batch.column(3).take(end), *(c.take(at) for c in rest)],
            [*RUN, *batch.schema.names[4:]])


def from_voxels(voxels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of consecutive voxels; ``carry`` columns are constant per run.

    Runs are cut in the task that reads the voxels, so runs are shuffled, not voxels.
    """
    types = {c: voxels.schema[c].dataType.simpleString() for c in (*LINE, "x", *carry)}
    kept = {**{c: types[c] for c in LINE}, "x0": types["x"], "x1": types["x"], **{c: types[c] for c in carry}}
    pieces = voxels.select(*types).mapInArrow(_in_runs, ", ".join(f"`{c}` {t}" for c, t in kept.items()))
    return joined(pieces, carry)


def joined(runs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint runs, those that touch along a line and agree in ``carry`` made one."""
    keys = [*LINE, *carry]
    line = W.partitionBy(*keys).orderBy("x0")
    opens = F.coalesce((F.lag("x1").over(line) + 1 < F.col("x0")).cast("int"), F.lit(1))
    numbered = runs.select(*RUN, *carry).withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(line))
    return numbered.groupBy(*keys, "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(*RUN, *carry)


def to_voxels(runs: DataFrame) -> DataFrame:
    rest = [c for c in runs.columns if c not in RUN]
    return runs.select(*LINE, F.explode(F.sequence("x0", "x1")).alias("x"), *rest)


def covered(intervals: DataFrame, wanted) -> DataFrame:
    """Maximal stretches of a line where ``wanted(cover count)`` holds.

    Intervals may overlap.  One sweep over the end points of a line: the running
    sum (peers included) is the cover count from that point on.
    """
    # The line travels in the struct: a union of tables that are each partitioned by line
    # would else pass for partitioned by line, though their partitions need not agree.
    ends = intervals.select(
        "vol_id",
        F.explode(
            F.array(
                F.struct("z", "y", F.col("x0").alias("x"), F.lit(1).alias("step")),
                F.struct("z", "y", (F.col("x1") + 1).alias("x"), F.lit(-1).alias("step")),
            )
        ).alias("e"),
    ).select("vol_id", "e.z", "e.y", "e.x", "e.step")
    line = W.partitionBy(*LINE).orderBy("x")
    inside = ends.withColumn("_in", wanted(F.sum("step").over(line)))
    changes = inside.withColumn(
        "_was", F.coalesce(F.lag("_in").over(line), F.lit(False))
    ).filter("_in <> _was")
    return (
        changes.withColumn("x1", F.lead("x").over(line) - 1)
        .filter("_in")
        .select(*LINE, F.col("x").alias("x0"), "x1")
    )


def union(*masks: DataFrame) -> DataFrame:
    return covered(union_all(*[m.select(*RUN) for m in masks]), lambda n: n >= 1)


def shift(runs: DataFrame, catalog: DataFrame, spans: list[tuple[int, int, int, int]], grow: bool) -> DataFrame:
    """Runs moved onto every line of a structuring element.

    ``grow`` widens them by the span of that line (dilation), otherwise they are
    narrowed so that the whole span stays inside the run (erosion).
    """
    from .offsets import span_column

    moved = runs.select(*RUN, F.explode(span_column(spans)).alias("s"))
    sign = 1 if grow else -1
    moved = moved.select(
        "vol_id",
        (F.col("z") + sign * F.col("s.dz")).alias("z"),
        (F.col("y") + sign * F.col("s.dy")).alias("y"),
        (F.col("x0") + sign * F.col("s.dx0")).alias("x0"),
        (F.col("x1") + sign * F.col("s.dx1")).alias("x1"),
    )
    return clip(moved, catalog)


def clip(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cut runs to the bounds of their volume."""
    sized = lookup_join(runs, catalog.select("vol_id", "depth", "height", "width"), ["vol_id"])
    rest = [c for c in runs.columns if c not in RUN]
    return (
        sized.filter("z >= 0 and z < depth and y >= 0 and y < height")
        .select(
            *LINE,
            F.greatest("x0", F.lit(0)).alias("x0"),
            F.least("x1", F.col("width") - 1).alias("x1"),
            *rest,
        )
        .filter("x0 <= x1")
    )


def full_lines(catalog: DataFrame) -> DataFrame:
    """Every line of every volume as one run."""
    lines = catalog.withColumn("z", F.explode(F.expr("sequence(0, depth - 1)"))).withColumn(
        "y", F.explode(F.expr("sequence(0, height - 1)"))
    )
    return lines.select(*LINE, F.lit(0).alias("x0"), (F.col("width") - 1).alias("x1"))


def complement(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Voxels of the volumes outside the (disjoint) runs."""
    return covered(union_all(full_lines(catalog), runs.select(*RUN)), lambda n: n == 1)


def blocks(runs: DataFrame, width: int = BLOCK) -> DataFrame:
    """Runs cut at multiples of ``width``, with the number ``xb`` of their block."""
    first, last = (F.floor(F.col(c) / width).cast("int") for c in ("x0", "x1"))
    cut = runs.withColumn("xb", F.explode(F.sequence(first, last)))
    return cut.withColumns(
        {
            "x0": F.greatest("x0", F.col("xb") * width),
            "x1": F.least("x1", F.col("xb") * width + (width - 1)),
        }
    )


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common stretches of two run tables, keeping the other columns of both.

    Runs meet per block of a line, so a line crowded with runs does not pair
    them all; stretches end at block borders.
    """
    b = blocks(right).withColumnsRenamed({"x0": "_b0", "x1": "_b1"})
    rest = [c for c in [*left.columns, *right.columns] if c not in RUN]
    return (
        blocks(left).join(b, [*LINE, "xb"])
        .filter("x0 <= _b1 and _b0 <= x1")
        .select(*LINE, F.greatest("x0", "_b0").alias("x0"), F.least("x1", "_b1").alias("x1"), *rest)
    )


def length() -> Column:
    return (F.col("x1") - F.col("x0") + 1).cast("long")


def place(z: str = "z", y: str = "y", x: str = "x0") -> Column:
    """Raster position of a voxel as one long that sorts by (z, y, x)."""
    return (
        F.shiftleft(F.col(z).cast("long"), 42)
        .bitwiseOR(F.shiftleft(F.col(y).cast("long"), 21))
        .bitwiseOR(F.col(x).cast("long"))
    )
