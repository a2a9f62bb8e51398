"""Tiles of a volume as groups of brick rows, with one layer of their neighbours.

A tile is a cube of ``tile`` voxels a side.  Its group holds packed stretches of
lines, ``(vol_id, tz, ty, tx, z, y, x0, v)``: its own, and those of the layer around
it.  Stretches of neighbours in z and y are whole, of neighbours in x one value.
So what is shuffled is arrays, not voxel rows.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import by_block
from .bricks import SPAN

BLOCK = ["vol_id", "tz", "ty", "tx"]


def _stretches(bricks: DataFrame, value: str, tile: int) -> DataFrame:
    """Brick rows as stretches of at most ``tile`` values that are not all zero."""
    rows = bricks.select("vol_id", "z", "y", (F.col("xb") * SPAN).alias("x0"), F.col(value).alias("v"))
    if tile < SPAN:
        if SPAN % tile:
            raise ValueError(f"a tile of {tile} does not divide {SPAN}")
        parts = F.transform(F.sequence(F.lit(0), F.lit(SPAN // tile - 1)), lambda k: F.slice("v", k * tile + 1, tile))
        rows = rows.select("vol_id", "z", "y", "x0", F.posexplode(parts).alias("_k", "v"))
        rows = rows.filter("size(v) > 0").withColumn("x0", F.col("x0") + F.col("_k") * tile).drop("_k")
    elif tile % SPAN:
        raise ValueError(f"a tile of {tile} is no multiple of {SPAN}")
    return rows.filter(F.array_max("v") > 0)


def exchange(bricks: DataFrame, value: str, tile: int, corners: bool) -> DataFrame:
    """Stretches under their own tile and under each tile that they border.

    ``corners`` counts neighbours across edges and corners too, else only across faces.
    Brick rows hold non-negative values; rows of zeros are left out.  Coordinates begin at 0.
    """
    rows = _stretches(bricks, value, tile)
    own = [F.floor(F.col(c) / tile).cast("int") for c in ("z", "y", "x0")]
    last = F.col("x0") + F.size("v") - 1
    # Stretches of a first or last layer border other tiles; those of the volume's first layers have none before them.
    borders = {(c, s): (F.col(c) % tile == (0 if s < 0 else tile - 1)) & ((F.col(c) > 0) if s < 0 else F.lit(True)) for c in ("z", "y") for s in (-1, 1)}
    borders |= {("x0", -1): (F.col("x0") % tile == 0) & (F.col("x0") > 0), ("x0", 1): (last + 1) % tile == 0}
    copies = []
    for step in itertools.product((-1, 0, 1), repeat=3):
        if not corners and sum(map(abs, step)) > 1:
            continue
        there = F.lit(True)
        for c, s in zip(("z", "y", "x0"), step):
            if s:
                there = there & borders[c, s]
        target = [(o + s).cast("int").alias(n) for o, s, n in zip(own, step, BLOCK[1:])]
        copies.append((F.struct(*target, F.lit(step[2]).alias("sx")), there if any(step) else None))
    alone = F.array(*(target for target, there in copies if there is None))
    every = F.array_compact(F.array(*(target if there is None else F.when(there, target) for target, there in copies)))
    met = rows.select("*", F.explode(F.when(functools.reduce(operator.or_, borders.values()), every).otherwise(alone)).alias("b"))
    ends = F.when(F.col("b.sx") < 0, F.slice("v", 1, 1)).when(F.col("b.sx") > 0, F.slice("v", -1, 1)).otherwise(F.col("v"))
    start = F.when(F.col("b.sx") > 0, last).otherwise(F.col("x0"))
    met = met.filter("b.tz >= 0 and b.ty >= 0 and b.tx >= 0").select("vol_id", "b.tz", "b.ty", "b.tx", "z", "y", start.cast("int").alias("x0"), ends.alias("v"))
    return met.filter(F.array_max("v") > 0)


def cut(runs: DataFrame, tile: int, *carry: Column) -> DataFrame:
    """Runs cut at tile borders, under their own tile."""
    first, last = (F.floor(F.col(c) / tile).cast("int") for c in ("x0", "x1"))
    parts = runs.select("vol_id", "z", "y", "x0", "x1", *carry, F.explode(F.sequence(first, last)).alias("tx"))
    return parts.withColumns({
        "tz": F.floor(F.col("z") / tile).cast("int"), "ty": F.floor(F.col("y") / tile).cast("int"),
        "x0": F.greatest("x0", F.col("tx") * tile), "x1": F.least("x1", F.col("tx") * tile + (tile - 1))})


#: Values that are held as cubes at a time: they stay in the cache.
CELLS = 1 << 17


def cubes(own: np.ndarray, z: np.ndarray, y: np.ndarray, x0: np.ndarray, lists: pa.Array, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of many groups as dense values: (numbers of the groups, their cubes, the first voxel of each cube).

    ``own`` numbers the groups in ascending order.  The cubes of one array are as large as its largest
    group with an empty layer around it; an array holds some ``cells`` values, or one group.
    """
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(values)
    if not len(at):
        return
    begins = np.cumsum(lengths) - lengths
    row = np.searchsorted(begins + lengths, at, "right")
    place = [z[row].astype(np.int64), y[row].astype(np.int64), at - begins[row] + x0[row]]
    group, value = own[row], values[at]
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    until = np.append(cuts[1:], len(group))
    low = np.stack([np.minimum.reduceat(c, cuts) - 1 for c in place], 1)
    shape = np.stack([np.maximum.reduceat(c, cuts) + 2 for c in place], 1) - low
    first = 0
    while first < len(cuts):
        box, last = shape[first], first + 1
        while last < len(cuts) and (last + 1 - first) * np.prod(wide := np.maximum(box, shape[last])) <= cells:
            box, last = wide, last + 1
        a, b = cuts[first], until[last - 1]
        of = np.repeat(np.arange(last - first), (until - cuts)[first:last])
        cube = np.zeros((last - first, *box), values.dtype)
        cube[(of, *(c[a:b] - low[first:last, k][of] for k, c in enumerate(place)))] = value[a:b]
        yield group[cuts[first:last]], cube, low[first:last]
        first = last


def in_tables(df: DataFrame, work, schema: str, rows: int, keys: list[str] = BLOCK) -> DataFrame:
    """Rows that ``work`` makes of tables of some ``rows`` rows with whole groups, sorted by the first columns ``keys``.

    A group is held by one task, and many small groups share a call.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, len(keys), rows):
            for made in work(table):
                yield from made.to_batches()

    return by_block(df.select(*keys, *(c for c in df.columns if c not in keys)), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def numbers_of(table: pa.Table, keys: int) -> np.ndarray:
    """The number of its group for every row of such a table."""
    own = np.zeros(table.num_rows, np.int64)
    own[group_starts(table, keys)[1:]] = 1
    return np.cumsum(own)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of some ``rows`` rows that no group is split between; the first ``keys`` columns, sorted, name the group.

    For tasks with many small groups: one call works on all groups of a table at once.
    """
    held, n, enough = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        names = [pc.fill_null(table.column(k), -(2**31)).to_numpy() for k in range(keys)]
        last = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in names])))
        if last:
            yield table.slice(0, last)
            table, n = table.slice(last), n - last
        held, enough = table.to_batches(), max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: int) -> np.ndarray:
    """First row of each group of such a table."""
    names = [pc.fill_null(table.column(k), -(2**31)).to_numpy() for k in range(keys)]
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in names], axis=0)))
