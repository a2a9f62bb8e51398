"""Gaussian background and flattening of dense gray volumes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bricks
from ..functions.numeric import gaussian_taps, smooth_columns
from ..functions.quantiles import brick_quantiles
from ..params import Flatten
from ..session import by_block, discard, lookup_join, store
from .intensity import stretch

# Planes and lines that one task call filters together.
_PLANES = 8
_LINES = 64
#: Most values of the planes that one task call filters as a whole, along every axis, and columns of a step.
_WHOLE, _STEP = 1 << 20, 4096
_COLUMNS = ["vol_id", "z", "y", "xb", "v", "bg"]
_SCHEMA = "vol_id int, z int, y int, xb int, v array<float>, bg array<float>"


def _smooth_axis(rows: DataFrame, axis: str, sigma: float) -> DataFrame:
    """Filter ``bg`` along ``z`` or ``y``, a few planes per task call; ``v`` rides along."""
    taps = gaussian_taps(sigma)
    across = "y" if axis == "z" else "z"

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by([(axis, "ascending"), (across, "ascending")])
        block = bricks.matrix(table["bg"])
        n = len(pc.unique(table[axis]))
        smooth = smooth_columns(block.reshape(n, -1), taps).reshape(block.shape)
        return _with_background(table, bricks.as_lists(smooth))

    return _by_planes(rows, across, _PLANES, "xb").applyInArrow(apply, _SCHEMA)


def _smooth_x(rows: DataFrame, sigma: float) -> DataFrame:
    """Filter ``bg`` along x, a few whole lines per task call."""
    taps = gaussian_taps(sigma)

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("z", "y", "xb")])
        lists = table["bg"].combine_chunks()
        lines = len(table) // len(pc.unique(table["xb"]))
        block = lists.flatten().to_numpy(zero_copy_only=False).reshape(lines, -1)
        smooth = np.ascontiguousarray(smooth_columns(block.T, taps).T).reshape(-1)
        return _with_background(table, pa.ListArray.from_arrays(lists.offsets, pa.array(smooth)))

    rows = rows.withColumn("lines", F.floor(F.col("y") / _LINES).cast("int"))
    return _by_planes(rows, "z", _PLANES, "lines").applyInArrow(apply, _SCHEMA)


def _by_planes(rows: DataFrame, coordinate: str, size: int, fixed: str):
    """Group rows by a range of one coordinate and a second, fixed one."""
    block = ["vol_id", "part", fixed]
    rows = rows.withColumn("part", F.floor(F.col(coordinate) / size).cast("int"))
    return by_block(rows, *block).groupBy(*block)


def _with_background(table: pa.Table, bg: pa.Array) -> pa.Table:
    return table.set_column(table.schema.get_field_index("bg"), "bg", bg).select(_COLUMNS)


def _smooth(cube: np.ndarray, axis: int, sigma: float) -> np.ndarray:
    """The cube filtered along one axis, some columns at a time."""
    taps = gaussian_taps(sigma)
    front = np.moveaxis(cube, axis, 0)
    block = np.ascontiguousarray(front).reshape(len(front), -1)
    smooth = np.concatenate([smooth_columns(block[:, k:k + _STEP], taps) for k in range(0, block.shape[1], _STEP)], axis=1)
    return np.moveaxis(smooth.reshape(front.shape), 0, axis)


def _smooth_whole(gray: DataFrame, value: str, planes: int, sigmas: dict[int, float]) -> DataFrame:
    """All axes in one call for ``planes`` whole planes (0: the volume), so values are shuffled once, packed."""
    def apply(table: pa.Table) -> pa.Table:
        z, y, v, length = bricks.dense_block(table, "float", 0)
        shape = (len(np.unique(z)), len(np.unique(y)), v.shape[1])
        if shape[0] * shape[1] != len(z) or (length != shape[2]).any():
            raise ValueError("the lines of a dense volume differ in number or length")
        bg = v.reshape(shape)
        for axis, sigma in sigmas.items():
            bg = _smooth(bg, axis, sigma)
        first = np.arange(0, shape[2], bricks.SPAN)
        starts = (np.arange(len(z))[:, None] * shape[2] + first).reshape(-1)
        offsets = pa.array(np.append(starts, v.size).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(c).reshape(-1))) for c in (v, bg)]
        n = len(starts)
        return pa.table([
            pa.array(np.full(n, table["vol_id"][0].as_py(), np.int32)), *(pa.array(np.repeat(c, len(first)).astype(np.int32)) for c in (z, y)),
            pa.array(np.tile(first // bricks.SPAN, len(z)).astype(np.int32)), *lists], _COLUMNS)

    packed = bricks.pack_blocks(gray, value, "float", (planes, 0, 0))
    return by_block(packed, *bricks.BLOCK).groupBy(*bricks.BLOCK).applyInArrow(apply, _SCHEMA)


def _extent(gray: DataFrame) -> tuple[int, int]:
    """Most planes of a volume, and most values of a plane."""
    x = F.max("xb") * bricks.SPAN + bricks.SPAN - 1 if "xb" in gray.columns else F.max("x")
    z, y, x = (int(c or 0) + 1 for c in gray.agg(F.max("z"), F.max("y"), x).first())
    return z, y * x


def gaussian_background(gray: DataFrame, lambda_xy: float, sigma_z: float = 0.0, value: str = "gray") -> DataFrame:
    """Brick rows with the gray values ``v`` and their background ``bg``.

    ``gray`` are voxels, or brick rows with ``v``.  Per slice for ``sigma_z`` 0, else in
    3D; slow axes first, float32 between passes.  Planes (in 3D volumes) of up to ``_WHOLE``
    values are filtered along all axes in one call, larger ones axis by axis in blocks; the
    arithmetic is the same.
    """
    depth, plane = _extent(gray)
    if plane <= _WHOLE and (sigma_z <= 0 or depth * plane <= _WHOLE):
        axes = {1: lambda_xy, 2: lambda_xy}
        source = "v" if "xb" in gray.columns else value
        return _smooth_whole(gray, source, 0 if sigma_z > 0 else max(1, _WHOLE // plane), {0: sigma_z, **axes} if sigma_z > 0 else axes)
    rows = gray if "xb" in gray.columns else bricks.from_voxels(gray, value)
    rows = rows.select("vol_id", "z", "y", "xb", F.col("v").cast("array<float>").alias("v")).withColumn("bg", F.col("v"))
    if sigma_z > 0:
        rows = _smooth_axis(rows, "z", sigma_z)
    rows = _smooth_axis(rows, "y", lambda_xy)
    return _smooth_x(rows, lambda_xy)


def background_reference(background: DataFrame) -> DataFrame:
    """Median background over positive values, over all values where none is."""
    median = brick_quantiles(background, "bg", [50.0], ["bg_ref"], positive=True)
    return median.select("vol_id", F.col("bg_ref").cast("float").alias("bg_ref"))


def _flat(v: np.ndarray, bg: np.ndarray, reference: np.ndarray) -> np.ndarray:
    return np.maximum(v - bg + reference, np.float32(0))


def _eight_bit(flat: np.ndarray, low: np.ndarray, span: np.ndarray) -> np.ndarray:
    return np.clip((flat - low) * np.float32(255) / span, np.float32(0), np.float32(255)).astype(np.int32)


def flatten_raw(background: DataFrame, reference: DataFrame) -> DataFrame:
    """Brick rows ``flat`` of ``v - bg + bg_ref`` clipped at zero, in float32."""
    return bricks.with_values(lookup_join(background, reference, ["vol_id"]), ["v", "bg"], ["bg_ref"], "flat", "float", _flat)


def flatten_bricks(gray: DataFrame, params: Flatten = Flatten(), value: str = "gray") -> DataFrame:
    """Flattened 8-bit volume as brick rows ``(vol_id, z, y, xb, flat)``; no voxel row is made on the way."""
    background = store(gaussian_background(gray, params.lambda_xy, params.sigma_z, value), "background")
    raw = store(flatten_raw(background, background_reference(background)), "flat")
    discard(background)
    ends = stretch(brick_quantiles(raw, "flat", [params.p_low, params.p_high], ["_lo", "_hi"], positive=True))
    return bricks.with_values(lookup_join(raw, ends, ["vol_id"]), ["flat"], ["_lo", "_range"], "flat", "int", _eight_bit)


def flatten(voxels: DataFrame, params: Flatten = Flatten(), value: str = "gray") -> DataFrame:
    """Flattened 8-bit volume ``(vol_id, z, y, x, flat)``."""
    return bricks.to_voxels(flatten_bricks(voxels, params, value))
