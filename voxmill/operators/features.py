"""Per-component shape and gray-level features.

Components come as runs ``(vol_id, z, y, x0, x1, component)``.  Sampling brings
each centroid to the packed tiles of the gray volume that it reaches, so no
voxel-level join is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions import tiles as T
from ..functions.bricks import BLOCK, SPAN, dense_block, from_voxels, pack_blocks
from ..functions.offsets import ball_spans, cube_spans, ring_spans, span_column
from ..params import SCORE_REFERENCE, SCORE_WEIGHT
from ..session import by_block, lookup_join

ID = ["vol_id", "component"]
#: Side of a packed tile of gray values, points that one step looks at, and lines of points.
TILE, _POINTS, _PAIRS = SPAN, 4096, 1 << 20


def shapes(components: DataFrame) -> DataFrame:
    """Area, bounding box (inclusive), and coordinate sums, from runs alone."""
    n = R.length()
    return components.groupBy(*ID).agg(
        F.sum(n).alias("area"),
        F.min("z").alias("z0"), F.max("z").alias("z1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        (F.sum(F.col("z") * n) / F.sum(n)).alias("mean_z"),
        (F.sum(F.col("y") * n) / F.sum(n)).alias("mean_y"),
        (F.sum((F.col("x0") + F.col("x1")) * n) / 2 / F.sum(n)).alias("mean_x"),
    )


def extents(shape: DataFrame) -> DataFrame:
    """``dz, dy, dx, max_dim, elongation, fill`` of the bounding box."""
    sides = {"d" + c: F.col(c + "1") - F.col(c + "0") + 1 for c in "zyx"}
    wide = shape.withColumns(sides).withColumn("max_dim", F.greatest("dx", "dy", "dz"))
    shortest = F.greatest(F.lit(1), F.least("dx", "dy", "dz"))
    box = F.col("dx").cast("long") * F.col("dy") * F.col("dz")
    return wide.withColumn("elongation", F.col("max_dim") / shortest).withColumn("fill", F.col("area") / box)


def centroids(shape: DataFrame, catalog: DataFrame) -> DataFrame:
    """Centroid voxel ``z, y, x``: mean, rounded half to even, inside the volume."""
    sized = lookup_join(shape, catalog, ["vol_id"])
    for c, side in zip("zyx", ("depth", "height", "width")):
        at = F.rint("mean_" + c).cast("int")
        sized = sized.withColumn("c" + c, F.least(F.greatest(at, F.lit(0)), F.col(side) - 1))
    return sized.drop("mean_z", "mean_y", "mean_x")


def mask_share(components: DataFrame, mask: DataFrame, name: str) -> DataFrame:
    """Share of each component's voxels that lie in the mask runs."""
    common = R.overlap(components.select(*R.RUN, "component"), mask.select(*R.RUN))
    hits = common.groupBy(*ID).agg(F.sum(R.length()).alias("_hit"))
    sizes = components.groupBy(*ID).agg(F.sum(R.length()).alias("_n"))
    share = F.coalesce("_hit", F.lit(0)) / F.col("_n")
    return sizes.join(hits, ID, "left").select(*ID, share.alias(name))


def _stretches(points: DataFrame, catalog: DataFrame, spans) -> DataFrame:
    """In-bounds line stretches around each centroid."""
    moved = points.select(*ID, "cz", "cy", "cx", F.explode(span_column(spans)).alias("s")).select(
        *ID,
        "cz", "cy", "cx",
        (F.col("cz") + F.col("s.dz")).alias("z"),
        (F.col("cy") + F.col("s.dy")).alias("y"),
        (F.col("cx") + F.col("s.dx0")).alias("x0"),
        (F.col("cx") + F.col("s.dx1")).alias("x1"),
    )
    return R.clip(moved, catalog)


def _nearest(table: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the points of such a table that have a run of their tile in their cube, and the least squared distance to one.

    A table holds whole groups: the runs of a tile, and the points that reach it with ``x0`` their own x.
    """
    own = np.zeros(table.num_rows, np.int64)
    own[T.group_starts(table, 4)[1:]] = 1
    own = np.cumsum(own)
    tz, ty, tx, z, y, x0, x1 = (table[c].to_numpy().astype(np.int64) for c in (*BLOCK[1:], "z", "y", "x0", "x1"))
    point = table["point"].to_numpy(zero_copy_only=False)
    z, y, x0, x1 = z - tz * TILE, y - ty * TILE, x0 - tx * TILE, x1 - tx * TILE
    # Places on one axis: the lines of the tiles one after the other, each with room for points beside the tile.
    wide = TILE + 2 * radius + 2
    line = ((own * TILE + z) * TILE + y) * wide + radius + 1
    left, right = (line + x0)[~point], (line + x1)[~point]
    order = np.argsort(left, kind="stable")
    left, right = left[order], np.maximum.accumulate(right[order])
    asked = np.flatnonzero(point)
    if not len(left):
        return asked[:0], asked[:0]
    dz, dy = (c.reshape(-1) for c in np.mgrid[-radius:radius + 1, -radius:radius + 1])
    best = np.full(len(asked), np.iinfo(np.int64).max)
    step = max(1, _PAIRS // len(dz))
    for k in range(0, len(asked), step):
        rows = asked[k:k + step, None]
        there = (z[rows] + dz >= 0) & (z[rows] + dz < TILE) & (y[rows] + dy >= 0) & (y[rows] + dy < TILE)
        place = line[rows] + x0[rows] + (dz * TILE + dy) * wide
        after = np.searchsorted(right, place)
        here = place // wide
        for at, ends in ((after, left), (after - 1, right)):
            met = there & (at >= 0) & (at < len(left))
            at = np.where(met, at, 0)
            dx = np.maximum(0, ends[at] - place if ends is left else place - ends[at])
            met &= (ends[at] // wide == here) & (dx <= radius)
            d2 = np.where(met, dz * dz + dy * dy + dx * dx, best[k:k + step, None])
            best[k:k + step] = d2.min(axis=1)
    found = best < np.iinfo(np.int64).max
    return asked[found], best[found]


def nearest_in_mask(points: DataFrame, mask: DataFrame, catalog: DataFrame, radius: int) -> DataFrame:
    """Distance to the nearest mask voxel in a cube; infinite when there is none.

    Points meet the runs of the tiles that their cube reaches: one row a point and tile.
    """
    radius = int(radius)
    asked = _around(points, catalog, cube_spans(radius))
    kind = {c: asked.schema[c].dataType.simpleString() for c in ID}
    names = [*BLOCK, "z", "y", "x0", "x1"]
    runs = T.cut(mask, TILE).select(*(F.col(c).cast("int").alias(c) for c in names), F.lit(None).cast(kind["component"]).alias("component"), F.lit(False).alias("point"))
    asked = asked.select(*BLOCK, *(F.col("c" + c).cast("int").alias(n) for c, n in (("z", "z"), ("y", "y"), ("x", "x0"), ("x", "x1"))), "component", F.lit(True).alias("point"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.whole_groups(batches, 4):
            rows, d2 = _nearest(table, radius)
            yield from table.select(ID).take(pa.array(rows)).append_column("_d2", pa.array(d2)).to_batches()

    met = by_block(runs.unionByName(asked), *BLOCK).sortWithinPartitions(*BLOCK)
    best = met.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in kind.items()), "_d2 long"]))
    best = best.groupBy(*ID).agg(F.min("_d2").alias("_d2"))
    distance = F.coalesce(F.sqrt(F.col("_d2").cast("double")), F.lit(float("inf")))
    return points.select(*ID).join(best, ID, "left").select(
        *ID, F.col("_d2").isNotNull().alias("near_internal"), distance.alias("internal_dist")
    )


def pack_lines(voxels: DataFrame, value: str) -> DataFrame:
    """Dense gray volume as one array per block of a line."""
    return from_voxels(voxels, value, voxels.schema[value].dataType.simpleString()).withColumnRenamed("v", "values")


def pack_tiles(gray: DataFrame, value: str = "values") -> DataFrame:
    """Dense gray volume, voxels or packed lines, as packed tiles: what ``contrasts`` shuffles, once."""
    return pack_blocks(gray, value, "long", (TILE,) * 3)


def _around(points: DataFrame, catalog: DataFrame, spans: list) -> DataFrame:
    """The points under every tile that their neighbourhoods reach, with the last voxel of their volume."""
    sized = lookup_join(points.select(*ID, "cz", "cy", "cx"), catalog.select("vol_id", "depth", "height", "width"), ["vol_id"])
    reach = {"z": [s[0] for s in spans], "y": [s[1] for s in spans], "x": [e for s in spans for e in s[2:]]}
    for c, side in zip("zyx", ("depth", "height", "width")):
        first = F.floor(F.greatest(F.col("c" + c) + min(reach[c]), F.lit(0)) / TILE)
        last = F.floor(F.least(F.col("c" + c) + max(reach[c]), F.col(side) - 1) / TILE)
        sized = sized.withColumn("t" + c, F.explode(F.when(first <= last, F.sequence(first, last))))
    return sized.select(*(F.col(c).cast("int").alias(c) for c in BLOCK), "component", "cz", "cy", "cx", "depth", "height", "width")


def _span_sums(points: pa.Table, tile: tuple[np.ndarray, ...], spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Voxels of the stretches ``spans`` around each point that lie in the tile, and the sum of their values."""
    lines_z, lines_y, values, length = tile
    tz, ty, tx = (int(points[c][0].as_py()) * TILE for c in BLOCK[1:])
    upto = np.concatenate([np.zeros((len(values), 1), np.int64), np.cumsum(values, axis=1)], axis=1)
    line = np.full((TILE, TILE), -1, np.int64)
    line[lines_z - tz, lines_y - ty] = np.arange(len(values))
    n, total = (np.zeros(points.num_rows, np.int64) for _ in range(2))
    centre = [points[c].to_numpy().astype(np.int64)[:, None] for c in ("cz", "cy", "cx")]
    size = [points[c].to_numpy().astype(np.int64)[:, None] for c in ("depth", "height", "width")]
    for k in range(0, points.num_rows, _POINTS):
        (cz, cy, cx), (depth, height, width) = ([c[k:k + _POINTS] for c in of] for of in (centre, size))
        z, y = cz + spans[:, 0], cy + spans[:, 1]
        inside = (z >= tz) & (z < np.minimum(depth, tz + TILE)) & (y >= ty) & (y < np.minimum(height, ty + TILE))
        at = np.where(inside, line[(z - tz) % TILE, (y - ty) % TILE], -1)
        x0 = np.maximum(cx + spans[:, 2] - tx, 0)
        x1 = np.minimum(np.minimum(cx + spans[:, 3], width - 1) - tx, length[at] - 1)
        met = (at >= 0) & (x0 <= x1)
        at, x0, x1 = (np.where(met, c, 0) for c in (at, x0, x1))
        n[k:k + _POINTS] = np.where(met, x1 - x0 + 1, 0).sum(1)
        total[k:k + _POINTS] = np.where(met, upto[at, x1 + 1] - upto[at, x0], 0).sum(1)
    return n, total


def sampled_means(points: DataFrame, tiles: DataFrame, catalog: DataFrame, wanted: dict[str, tuple[list, float]]) -> DataFrame:
    """Mean gray over neighbourhoods of each centroid, in-bounds voxels only.

    ``wanted`` names each mean, with its neighbourhood's stretches and the value of an
    empty one.  Points meet the ``tiles`` of ``pack_tiles`` that they reach: one row a point
    and tile, whatever the neighbourhoods, and every voxel is shuffled once, packed.
    """
    asked = _around(points, catalog, [s for spans, _ in wanted.values() for s in spans])
    shapes = [np.array(spans, np.int64).reshape(-1, 4) for spans, _ in wanted.values()]
    kind = {c: asked.schema[c].dataType.simpleString() for c in ID}
    sums = [f"{c}{k}" for k in range(len(shapes)) for c in ("_n", "_sum")]

    def meet(near: pa.Table, packed: pa.Table) -> pa.Table:
        tile = dense_block(packed, "long", packed["tx"][0].as_py() * TILE) if packed.num_rows else None
        if tile is None or not near.num_rows:
            near = near.slice(0, 0)
        found = [c for spans in shapes for c in (_span_sums(near, tile, spans) if near.num_rows else (np.zeros(0, np.int64),) * 2)]
        return pa.table([*(near[c] for c in ID), *map(pa.array, found)], [*ID, *sums])

    gray = by_block(tiles, *BLOCK).groupBy(*BLOCK)
    parts = by_block(asked, *BLOCK).groupBy(*BLOCK).cogroup(gray).applyInArrow(
        meet, ", ".join([*(f"{c} {t}" for c, t in kind.items()), *(f"{c} long" for c in sums)]))
    total = parts.groupBy(*ID).agg(*(F.sum(c).alias(c) for c in sums))
    means = [F.when(F.col(f"_n{k}") > 0, F.col(f"_sum{k}") / F.col(f"_n{k}")).alias(name) for k, name in enumerate(wanted)]
    empty = {name: value for name, (_, value) in wanted.items()}
    return points.select(*ID).join(total.select(*ID, *means), ID, "left").fillna(empty)


def ring_coverage(points: DataFrame, mask: DataFrame, catalog: DataFrame, inner: int, outer: int) -> DataFrame:
    """Share of the in-bounds ring voxels that lie in the mask; empty ring: 1."""
    asked = _stretches(points, catalog, ring_spans(inner, outer))
    sizes = asked.groupBy(*ID).agg(F.sum(R.length()).alias("_n"))
    hits = R.overlap(asked.select(*R.RUN, "component"), mask.select(*R.RUN))
    hits = hits.groupBy(*ID).agg(F.sum(R.length()).alias("_hit"))
    cover = F.coalesce(F.coalesce("_hit", F.lit(0)) / F.col("_n"), F.lit(1.0))
    return points.select(*ID).join(sizes, ID, "left").join(hits, ID, "left").select(
        *ID, cover.alias("ring_external_cov")
    )


def contrasts(points: DataFrame, lines: DataFrame, catalog: DataFrame, sampling) -> DataFrame:
    """Centre mean, ring mean, their difference and the marker score; ``lines`` are packed tiles, or packed lines."""
    tiles = lines if "tz" in lines.columns else pack_tiles(lines)
    means = sampled_means(points, tiles, catalog, {
        "center_mean": (ball_spans(sampling.center_radius), 255.0),
        "ring_mean": (ring_spans(sampling.ring_inner, sampling.ring_outer), 0.0)})
    contrast = F.col("ring_mean") - F.col("center_mean")
    bonus = F.greatest(F.lit(0.0), F.lit(SCORE_REFERENCE) - F.col("center_mean")) * SCORE_WEIGHT
    return means.withColumn("ring_contrast", contrast).withColumn("score", F.col("ring_contrast") + bonus)
