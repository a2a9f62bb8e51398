"""Dilation, erosion and closing of masks held as runs.

Runs go to columns of tiles (``TILE`` lines a side, with the ball's reach around them) and are
painted there a stretch at a time, so each run is shuffled once and not once per line of the ball.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions import tiles
from ..functions.numeric import expand, touching
from ..functions.offsets import ball_spans
from ..session import by_block, lookup_join, union_all

TILE = 64
#: Width of the stretches of a column that are painted at once.
STRETCH = 512
_RUNS = pa.schema([(c, pa.int32()) for c in R.RUN])


def _spread(block: np.ndarray, radius: int) -> np.ndarray:
    """The ball around every set voxel; what is outside the block counts as unset."""
    wide = np.pad(block, radius)
    out = np.zeros_like(block)
    for dz, dy, dx0, dx1 in ball_spans(radius):
        for dx in range(dx0, dx1 + 1):
            z, y, x = (radius + step for step in (dz, dy, dx))
            out |= wide[z:z + block.shape[0], y:y + block.shape[1], x:x + block.shape[2]]
    return out


def _shrink(block: np.ndarray, radius: int) -> np.ndarray:
    """Voxels whose whole ball is set and inside the block."""
    return ~_spread(np.pad(~block, radius, constant_values=True), radius)[(slice(radius, -radius or None),) * 3]


def _column(z, y, x0, x1, own: tuple[int, int], sides: tuple[int, int, int], reach: int, width: int, change: Callable) -> tuple[np.ndarray, ...]:
    """Changed runs of one column of tiles at the lines from ``own`` on."""
    low = [max(int(c.min()), start) - reach for c, start in zip((z, y), own)]
    high = [min(int(c.max()), start + TILE - 1) + reach for c, start in zip((z, y), own)]
    low = [max(a, start - reach) for a, start in zip(low, own)]
    found = []
    # Only stretches that a run reaches can hold a result.
    first, last = ((c // width).astype(np.int64) for c in (x0 - reach, x1 + reach))
    for part in np.unique(expand(first, last + 1)[1]):
        begin, end = int(part) * width, min(int(part + 1) * width, sides[2]) - 1
        met = np.flatnonzero((x1 >= begin - reach) & (x0 <= end + reach)) if begin <= end and end >= 0 else np.zeros(0, np.int64)
        if not len(met):
            continue
        left = max(begin, int(x0[met].min())) - reach
        right = min(end, int(x1[met].max())) + reach
        shape = (high[0] - low[0] + 1, high[1] - low[1] + 1, right - left + 1)
        if min(shape) <= 0:
            continue
        block = np.zeros(shape, bool)
        row, x = expand(np.maximum(x0[met], left), np.minimum(x1[met], right) + 1)
        line = met[row]
        inside = (z[line] >= low[0]) & (z[line] <= high[0]) & (y[line] >= low[1]) & (y[line] <= high[1])
        line, x = line[inside], x[inside]
        block[z[line] - low[0], y[line] - low[1], x - left] = True
        origin = (*low, left)
        kept = change(block, tuple(slice(max(0, -a), max(0, side - a)) for a, side in zip(origin, sides)))
        bounds = [(max(start, 0), min(start + TILE, side)) for start, side in zip(own, sides)] + [(max(begin, 0), end + 1)]
        box = [slice(max(0, a - o), max(0, b - o)) for (a, b), o in zip(bounds, origin)]
        core = kept[tuple(box)]
        base = [o + b.start for o, b in zip(origin, box)]
        edge = np.diff(np.pad(core, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
        starts, ends = np.nonzero(edge == 1), np.nonzero(edge == -1)
        found.append((starts[0] + base[0], starts[1] + base[1], starts[2] + base[2], ends[2] + base[2] - 1))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    if len(found) == 1:
        return found[0]
    rz, ry, ra, rb = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ra, ry, rz))
    rz, ry, ra, rb = rz[order], ry[order], ra[order], rb[order]
    at = touching([rz, ry], ra, rb)
    return rz[at], ry[at], ra[at], rb[np.append(at[1:], len(ra))[:len(at)] - 1]


def _in_columns(mask: DataFrame, catalog: DataFrame, reach: int, change: Callable[[np.ndarray, tuple], np.ndarray]) -> DataFrame:
    """Runs of what ``change`` makes of the mask around every column of tiles; it also gets the part of its block inside the volume."""
    width = STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_groups(batches, 3):
            vol_id = table.column(0)
            starts = tiles.group_starts(table, 3)
            tz, ty, z, y, x0, x1, *sides = (c.to_numpy().astype(np.int64) for c in table.columns[1:])
            parts = []
            for a, b in zip(starts, np.append(starts[1:], len(z))):
                own, sized = (int(tz[a]) * TILE, int(ty[a]) * TILE), tuple(int(s[a]) for s in sides)
                parts.append(_column(z[a:b], y[a:b], x0[a:b], x1[a:b], own, sized, reach, width, change))
            at = pa.array(np.repeat(starts, [len(p[0]) for p in parts]))
            made = [pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*parts)]
            yield from pa.table([vol_id.take(at), *made], schema=_RUNS).to_batches()

    sized = lookup_join(mask.select(*R.RUN), catalog.select("vol_id", "depth", "height", "width"), ["vol_id"])

    def columns(c: str, side: str):
        first = F.greatest(F.lit(0), F.floor((F.col(c) - reach) / TILE).cast("int"))
        return F.explode(F.sequence(first, F.floor(F.least(F.col(c) + reach, F.col(side) - 1) / TILE).cast("int")))

    near = sized.filter(f"z between {-reach} and depth - 1 + {reach} and y between {-reach} and height - 1 + {reach}")
    cut = near.withColumn("tz", columns("z", "depth")).withColumn("ty", columns("y", "height"))
    cut = cut.select(*(F.col(c).cast("int").alias(c) for c in ("vol_id", "tz", "ty", "z", "y", "x0", "x1", "depth", "height", "width")))
    dealt = by_block(cut, "vol_id", "tz", "ty").sortWithinPartitions("vol_id", "tz", "ty")
    return dealt.mapInArrow(run, ", ".join(f"{c} int" for c in R.RUN))


def dilate(mask: DataFrame, catalog: DataFrame, radius: int) -> DataFrame:
    """Voxels within ``radius`` of the mask, clipped to the volume."""
    return _in_columns(mask, catalog, radius, lambda block, _: _spread(block, radius))


def erode(mask: DataFrame, catalog: DataFrame, radius: int) -> DataFrame:
    """Voxels whose whole ball lies in the mask; outside the volume counts as unset."""
    return _in_columns(mask, catalog, radius, lambda block, _: _shrink(block, radius))


def close(mask: DataFrame, catalog: DataFrame, radius: int) -> DataFrame:
    """Dilation, then erosion, in one step with twice the reach."""
    if radius <= 0:
        return mask

    def change(block: np.ndarray, volume: tuple) -> np.ndarray:
        grown = np.zeros_like(block)
        grown[volume] = _spread(block, radius)[volume]
        return _shrink(grown, radius)

    return _in_columns(mask, catalog, 2 * radius, change)


def force_markers(mask: DataFrame, markers: DataFrame, catalog: DataFrame, radius: int) -> DataFrame:
    """Foreground joined with the markers dilated by ``radius`` (0: as they are)."""
    grown = dilate(markers, catalog, radius) if radius > 0 else markers
    return R.covered(union_all(mask.select(*R.RUN), grown.select(*R.RUN)), lambda n: n >= 1)
