"""Neighbourhoods as small fixed tables of voxel offsets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _cube(spark: SparkSession, radius: int) -> DataFrame:
    side = F.sequence(F.lit(-radius), F.lit(radius))
    cube = spark.range(1).select(F.explode(side).alias("dz"))
    cube = cube.select("dz", F.explode(side).alias("dy"))
    return cube.select("dz", "dy", F.explode(side).alias("dx"))


def ball(spark: SparkSession, radius: int) -> DataFrame:
    """Offsets with ``d2 <= radius^2``; a radius of zero or less is one voxel."""
    radius = max(0, int(radius))
    d2 = F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    return _cube(spark, radius).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def ring(spark: SparkSession, inner: int, outer: int) -> DataFrame:
    """In-plane offsets with ``inner^2 < d2 <= outer^2``."""
    flat = _cube(spark, int(outer)).filter("dz = 0")
    d2 = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    return flat.select("dy", "dx", d2.alias("d2")).filter(
        (F.col("d2") > int(inner) ** 2) & (F.col("d2") <= int(outer) ** 2)
    )


def neighbours(spark: SparkSession, k: int) -> DataFrame:
    """6, 18 or 26 neighbours for ``k`` = 1, 2, 3."""
    steps = F.abs("dz") + F.abs("dy") + F.abs("dx")
    return _cube(spark, 1).filter((steps >= 1) & (steps <= k))


def _spans(inside, zs: range, ys: range, reach: int) -> list[tuple[int, int, int, int]]:
    """Offset set as ``(dz, dy, dx0, dx1)`` stretches along x."""
    found = []
    for dz, dy in product(zs, ys):
        xs = [dx for dx in range(-reach, reach + 1) if inside(dz, dy, dx)]
        starts = [dx for dx in xs if dx - 1 not in xs]
        ends = [dx for dx in xs if dx + 1 not in xs]
        found += [(dz, dy, a, b) for a, b in zip(starts, ends)]
    return found


def ball_spans(radius: int) -> list[tuple[int, int, int, int]]:
    r = max(0, int(radius))
    side = range(-r, r + 1)
    return _spans(lambda z, y, x: z * z + y * y + x * x <= r * r, side, side, r)


def ring_spans(inner: int, outer: int) -> list[tuple[int, int, int, int]]:
    i2, o2 = int(inner) ** 2, int(outer) ** 2
    side = range(-int(outer), int(outer) + 1)
    return _spans(lambda z, y, x: i2 < y * y + x * x <= o2, range(1), side, int(outer))


def cube_spans(radius: int) -> list[tuple[int, int, int, int]]:
    r = int(radius)
    side = range(-r, r + 1)
    return _spans(lambda z, y, x: True, side, side, r)


def span_column(spans: list[tuple[int, int, int, int]]) -> Column:
    """The stretches as one constant array column, ready to explode."""
    rows = (f"named_struct('dz', {a}, 'dy', {b}, 'dx0', {c}, 'dx1', {d})" for a, b, c, d in spans)
    return F.expr(f"array({', '.join(rows)})")


def neighbour_steps(k: int) -> list[tuple[int, int, int, int]]:
    """The k-connected neighbours as stretches of one voxel."""
    cube = product(range(-1, 2), repeat=3)
    return [(z, y, x, x) for z, y, x in cube if 1 <= abs(z) + abs(y) + abs(x) <= k]
