"""Exact squared Euclidean distance to the background, axis by axis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bricks
from ..functions import runs as R
from ..functions import tiles
from ..functions.bricks import SPAN
from ..functions.numeric import FAR, expand, lower_envelope
from ..session import lookup_join

#: Planes that go together where a volume is not taken whole.
PLANES = 8
#: Most lines of a brick column that one call takes whole.
WHOLE = 1 << 14
#: Rows that one call takes at least, and values of a step of it.
_ROWS, _BLOCK = 1 << 14, 1 << 17
#: In the place of a run's last voxel: the row holds the size of the volume.
_SIZE = -1
_SCHEMA = "vol_id int, z int, y int, xb int, d2 array<long>"


def _along_x(lo, hi, first, last, width) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voxels ``x`` of each cut run with their squared distance along the line."""
    row, x = expand(lo, hi + 1)
    left = np.where(first[row] > 0, x - first[row] + 1, FAR)
    right = np.where(last[row] < width[row] - 1, last[row] - x + 1, FAR)
    near = np.minimum(left, right)
    return row, x, np.where(near >= FAR, FAR, near * near)


def _columns(own: np.ndarray, at: tuple[np.ndarray, ...], values: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Blocks with an axis of ``long`` voxels each, set at ``(position, *at)``, after the pass along it; the values at the same places.

    Groups of equal length go together, some ``_BLOCK`` values a step.
    """
    out = np.zeros(len(values), np.int64)
    shape = [int(c.max(initial=0)) + 1 for c in at[1:]]
    for n in np.unique(long[own]):
        groups = np.flatnonzero(long == n)
        step = max(1, _BLOCK // int(n * np.prod(shape)))
        for k in range(0, len(groups), step):
            local = np.full(len(long), -1)
            local[groups[k:k + step]] = np.arange(len(groups[k:k + step]))
            row = np.flatnonzero(local[own] >= 0)
            place = (at[0][row], local[own[row]], *(c[row] for c in at[1:]))
            block = np.zeros((int(n), len(groups[k:k + step]), *shape), np.int64)
            block[place] = values[row]
            out[row] = lower_envelope(block.reshape(int(n), -1)).reshape(block.shape)[place]
    return out


def _passes(whole: bool):
    """Passes along x and y, and along z if the groups hold ``whole`` columns of bricks, of all groups of a table."""
    def work(table: pa.Table) -> Iterator[pa.Table]:
        own = tiles.numbers_of(table, 3)
        vol_id, xb = (table[c].to_numpy()[tiles.group_starts(table, 3)] for c in ("vol_id", "xb"))
        z, y, x0, x1 = (table[c].to_numpy().astype(np.int64) for c in ("z", "y", "x0", "x1"))
        told = np.flatnonzero(x1 == _SIZE)
        depth, height, width = size = np.zeros((3, len(vol_id)), np.int64)
        size[:, own[told]] = z[told], y[told], x0[told]
        rows = np.flatnonzero((x1 != _SIZE) & (height[own] > 0))
        own, z, y, x0, x1 = (c[rows] for c in (own, z, y, x0, x1))
        if not len(rows):
            return
        start = xb[own].astype(np.int64) * SPAN
        row, x, g2 = _along_x(np.maximum(x0, start), np.minimum(x1, start + SPAN - 1), x0, x1, width[own])
        own, z, y, x = own[row], z[row], y[row], x - start[row]
        if (z < 0).any() or (y < 0).any() or (z >= depth[own]).any():
            raise IndexError("a voxel of the mask lies outside its volume")
        low = np.full(len(vol_id), np.iinfo(np.int64).max)
        np.minimum.at(low, own, z)
        d2 = _columns(own, (y, z - low[own], x), g2, height)
        if whole:
            d2 = _columns(own, (z, y, x), d2, depth)
        yield _lines(vol_id, xb, own, z, y, x, d2, np.minimum(SPAN, width - xb.astype(np.int64) * SPAN))

    return work


def _pass_z(table: pa.Table) -> Iterator[pa.Table]:
    """The pass along z of all groups of a table of lines."""
    own = tiles.numbers_of(table, 3)
    starts = tiles.group_starts(table, 3)
    vol_id, xb, depth = (table[c].to_numpy()[starts] for c in ("vol_id", "xb", "depth"))
    z, y = (table[c].to_numpy().astype(np.int64) for c in ("z", "y"))
    lists = table["d2"].combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(values)
    row = np.repeat(np.arange(len(lengths)), lengths)[at]
    x = at - (np.cumsum(lengths) - lengths)[row]
    wide = np.zeros(len(vol_id), np.int64)
    np.maximum.at(wide, own, lengths)
    low = np.full(len(vol_id), np.iinfo(np.int64).max)
    np.minimum.at(low, own, y)
    d2 = _columns(own[row], (z[row], y[row] - low[own[row]], x), values[at], depth.astype(np.int64))
    yield _lines(vol_id, xb, own[row], z[row], y[row], x, d2, wide)


def _lines(vol_id, xb, own, z, y, x, d2, wide) -> pa.Table:
    """Voxels as brick rows of their lines; a group's rows are ``wide`` values long, or up to the last voxel."""
    order = np.lexsort((y, z, own))
    own, z, y, x, d2 = (c[order] for c in (own, z, y, x, d2))
    opens = np.ones(len(own), bool)
    opens[1:] = (own[1:] != own[:-1]) | (z[1:] != z[:-1]) | (y[1:] != y[:-1])
    first = np.flatnonzero(opens)
    np.maximum.at(wide, own, x + 1)
    offsets = np.append(0, np.cumsum(wide[own[first]]))
    values = np.zeros(offsets[-1], np.int64)
    values[offsets[np.cumsum(opens) - 1] + x] = d2
    keys = {"vol_id": vol_id[own[first]], "z": z[first], "y": y[first], "xb": xb[own[first]]}
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
    return pa.table({**{k: pa.array(c.astype(np.int32)) for k, c in keys.items()}, "d2": lists})


def _dealt(mask: DataFrame, catalog: DataFrame, planes: int | None) -> DataFrame:
    """Runs under each brick column and ``planes`` planes (all: None) that they reach, with a row that tells the size of the volume."""
    part = F.lit(0) if planes is None else F.floor(F.col("z") / planes).cast("int")
    first, last = (F.floor(F.col(c) / SPAN).cast("int") for c in ("x0", "x1"))
    runs = mask.select(*R.RUN, part.alias("part"), F.explode(F.sequence(first, last)).alias("xb"))
    sizes = catalog.filter("vol_id is not null and least(depth, height, width) > 0")
    parts = F.lit(0) if planes is None else F.floor((F.col("depth") - 1) / planes).cast("int")
    sizes = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), parts)))
    sizes = sizes.withColumn("xb", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / SPAN).cast("int"))))
    names = {"vol_id": "vol_id", "part": "part", "xb": "xb", "z": "depth", "y": "height", "x0": "width"}
    told = sizes.select(*(F.col(c).cast("int").alias(n) for n, c in names.items()), F.lit(_SIZE).alias("x1"))
    return runs.select(*(F.col(c).cast("int").alias(c) for c in (*names, "x1"))).unionByName(told)


def distance_bricks(mask: DataFrame, catalog: DataFrame) -> DataFrame:
    """Brick rows of squared distances: 0 background, ``FAR`` without any background; lines without foreground are left out.

    The x pass needs only the ends of a run, so runs, not voxels, are shuffled.  Where the
    largest plane across x has up to ``WHOLE`` lines, one call takes whole brick columns, of many
    volumes; else ``PLANES`` neighbouring planes go through the y pass, and packed rows
    into the z pass.  The sizes of the volumes travel as rows of their own.
    """
    keys = ["vol_id", "part", "xb"]
    lines = catalog.agg(F.max(F.col("depth").cast("long") * F.col("height"))).first()[0]
    if (lines or 0) <= WHOLE:
        return tiles.in_tables(_dealt(mask, catalog, None), _passes(True), _SCHEMA, _ROWS, keys)
    half = tiles.in_tables(_dealt(mask, catalog, PLANES), _passes(False), _SCHEMA, _ROWS, keys)
    half = lookup_join(half, catalog.select("vol_id", "depth"), ["vol_id"])
    half = half.withColumn("part", F.floor(F.col("y") / PLANES).cast("int"))
    return tiles.in_tables(half, _pass_z, _SCHEMA, _ROWS, keys)


def distance_voxels(rows: DataFrame) -> DataFrame:
    """Foreground voxels with ``d2`` and ``distance``; null where undefined."""
    d2 = F.when(F.col("d2") < int(FAR), F.col("d2"))
    return bricks.to_voxels(rows).filter("d2 > 0").select(
        "vol_id", "z", "y", "x", d2.alias("d2"), F.sqrt(d2.cast("double")).alias("distance")
    )


def distance(mask: DataFrame, catalog: DataFrame) -> DataFrame:
    return distance_voxels(distance_bricks(mask, catalog))
