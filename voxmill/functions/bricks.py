"""Dense values as short rows along x, filtered one axis at a time.

A brick row ``(vol_id, z, y, xb, ...)`` carries ``SPAN`` values of one line as
arrays.  Filtering along an axis groups the rows that differ only in that
coordinate, so a task never holds more than one line length times ``SPAN``
values, and shuffles move packed arrays instead of voxel rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_block

SPAN = 64
KEYS = ("vol_id", "z", "y", "xb")


def brick() -> F.Column:
    return F.floor(F.col("x") / SPAN).cast("int")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column with equally long rows as a two-dimensional array."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def as_lists(block: np.ndarray) -> pa.Array:
    rows, width = block.shape
    offsets = pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(block).reshape(-1)))


def in_step(pieces: str, first: F.Column) -> F.Column:
    """Values of ``pieces`` (sorted structs ``x, v``, v an array) in a row, or an error if an x is missing or doubled."""
    follows = F.forall(
        F.sequence(F.lit(2), F.size(pieces)),
        lambda k: F.element_at(pieces, k)["x"] == F.element_at(pieces, k - 1)["x"] + F.size(F.element_at(pieces, k - 1)["v"]))
    whole = (F.element_at(pieces, 1)["x"] == first) & ((F.size(pieces) == 1) | follows)
    return F.when(whole, F.flatten(f"{pieces}.v")).otherwise(F.raise_error(F.lit("a line of a dense volume has a missing or doubled voxel")))


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The voxels ``(vol_id, z, y, x, value)`` of each batch as consecutive pieces of bricks."""
    for batch in batches:
        # A missing x becomes one that begins no brick, so that it is found.
        keys = [pc.fill_null(batch.column(k), -(2**31) + (k == 3)).to_numpy().astype(np.int64) for k in range(4)]
        step = [np.diff(k) for k in keys]
        ahead = np.select([step[0] != 0, step[1] != 0, step[2] != 0], step[:3], step[3]) > 0
        if not ahead.all():
            order = np.lexsort(keys[::-1])
            batch, keys = batch.take(pa.array(order)), [k[order] for k in keys]
        xb = np.floor_divide(keys[3], SPAN)
        opens = np.ones(len(xb), bool)
        opens[1:] = np.any([k[1:] != k[:-1] for k in (*keys[:3], xb)], axis=0) | (keys[3][1:] != keys[3][:-1] + 1)
        first = np.flatnonzero(opens)
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([
            *(batch.column(k).take(at) for k in range(3)), pa.array(xb[first].astype(np.int32)), pa.array(keys[3][first].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.append(first, len(xb)).astype(np.int32)), batch.column(4))], [*KEYS, "x", "v"])


def from_voxels(voxels: DataFrame, value: str, kind: str = "float") -> DataFrame:
    """Pack a dense voxel table; a voxel that is missing inside a line is an error.

    Bricks are cut in the task that reads the voxels, so arrays are shuffled, not voxels.
    """
    types = {c: voxels.schema[c].dataType.simpleString() for c in ("vol_id", "z", "y")}
    rows = voxels.select(*types, F.col("x").cast("int").alias("x"), F.col(value).cast(kind).alias("v"))
    schema = ", ".join(f"{c} {t}" for c, t in types.items())
    pieces = rows.mapInArrow(_in_pieces, f"{schema}, xb int, x int, v array<{kind}>")
    return (
        by_block(pieces, "vol_id", "z", "xb")
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("p"))
        .select(*KEYS, in_step("p", F.col("xb") * SPAN).alias("v"))
    )


def to_voxels(bricks: DataFrame) -> DataFrame:
    """Unpack all array columns of the brick rows in step."""
    keys = ("vol_id", "z", "y", "xb")
    arrays = [c for c in bricks.columns if c not in keys]
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("i", "e")
    return bricks.select("vol_id", "z", "y", "xb", zipped).select(
        "vol_id", "z", "y", (F.col("xb") * SPAN + F.col("i")).alias("x"), *[f"e.{a}" for a in arrays]
    )


BLOCK = ["vol_id", "tz", "ty", "tx"]
_BLOCK_TYPES = "vol_id int, tz int, ty int, tx int, z array<int>, y array<int>, x array<int>, n array<int>, low long, v binary"
_ABSENT = -(2**31)


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as their smallest and the differences from it, in as few bytes as hold them."""
    low = int(values.min())
    above = (values - low).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if int(above.max()) < 1 << 8 * w)
    return low, above.astype(f"<u{width}").tobytes()


def pack_blocks(rows: DataFrame, value: str, kind: str, sides: tuple[int, int, int]) -> DataFrame:
    """Dense values as one row per block of ``sides`` voxels and batch, packed by the task that reads them.

    ``rows`` are voxels, or brick rows with the array ``value``; ``kind`` is ``float`` or
    ``long``.  A side of 0 takes the whole axis.  A row holds stretches of lines: the first
    voxel ``z, y, x`` and the length ``n`` of each, and their values as bytes.
    """
    arrays = "xb" in rows.columns
    typed = F.col(value).cast(f"array<{kind}>" if arrays else kind)
    place = (F.col("xb") * SPAN if arrays else F.col("x")).cast("int")
    rows = rows.filter("vol_id is not null and z is not null and y is not null").select(
        *(F.col(c).cast("int").alias(c) for c in ("vol_id", "z", "y")), place.alias("x"), typed.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [pc.fill_null(batch.column(k), _ABSENT).to_numpy().astype(np.int64) for k in range(4)]
            if arrays:
                n = pc.fill_null(batch.column(4).value_lengths(), 0).to_numpy().astype(np.int64)
                found = batch.column(4).flatten()
            else:
                # A voxel of unlike line or block, or that does not follow, begins a stretch.
                opens = np.ones(len(keys[3]), bool)
                opens[1:] = np.any([k[1:] != k[:-1] for k in keys[:3]], axis=0) | (keys[3][1:] != keys[3][:-1] + 1)
                opens |= keys[3] % sides[2] == 0 if sides[2] else False
                first = np.flatnonzero(opens)
                n = np.diff(np.append(first, len(opens)))
                keys, found = [k[first] for k in keys], batch.column(4)
            if found.null_count:
                raise ValueError("a voxel of a dense volume has no value")
            values = found.to_numpy(zero_copy_only=False)
            block = [keys[0], *(k // side if side else np.zeros_like(k) for k, side in zip(keys[1:], sides))]
            starts = np.cumsum(n) - n
            order = np.lexsort(block[::-1])
            if not (np.diff(order) == 1).all():
                keys, block = [k[order] for k in keys], [b[order] for b in block]
                n, moved = n[order], starts[order]
                starts = np.cumsum(n) - n
                values = values[np.arange(len(values)) + np.repeat(moved - starts, n)]
            cuts = np.flatnonzero(np.append(True, np.any([b[1:] != b[:-1] for b in block], axis=0)))
            offsets = pa.array(np.append(cuts, len(n)).astype(np.int32))
            edges = np.append(starts[cuts], len(values))
            if kind == "float":
                low, packed = [0] * len(cuts), [values[a:b].astype("<f4").tobytes() for a, b in zip(edges, edges[1:])]
            else:
                low, packed = zip(*(_narrow(values[a:b]) if b > a else (0, b"") for a, b in zip(edges, edges[1:])))
            yield pa.RecordBatch.from_arrays([
                *(pa.array(b[cuts].astype(np.int32)) for b in block),
                *(pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in (*keys[1:], n)),
                pa.array(low, pa.int64()), pa.array(packed, pa.binary())], [*BLOCK, "z", "y", "x", "n", "low", "v"])

    return rows.mapInArrow(run, _BLOCK_TYPES)


def dense_block(table: pa.Table, kind: str, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The packed rows of one block as an array over its lines: (z and y of the lines, ascending, values, length of each line).

    All lines have to begin at x = ``begin``; shorter ones are filled up with zeros.  A voxel that is missing inside a line, or doubled, is an error.
    """
    z, y, x, n = (_flat(table[c].combine_chunks()).astype(np.int64) for c in ("z", "y", "x", "n"))
    parts = []
    for counts, low, v in zip(table["n"], table["low"], table["v"], strict=True):
        size, packed = sum(counts.as_py()), v.as_py()
        if kind == "float":
            parts.append(np.frombuffer(packed, "<f4"))
        else:
            parts.append(np.frombuffer(packed, f"<u{max(1, len(packed) // max(1, size))}").astype(np.int64) + low.as_py())
    values = np.concatenate(parts)
    line, row = np.unique(z << 32 | y, return_inverse=True)
    x = x - begin
    length = np.bincount(row, n, len(line)).astype(np.int64)
    order = np.lexsort((x, row))
    follows = (np.cumsum(n[order]) - n[order]) - np.repeat(np.cumsum(length) - length, np.bincount(row, minlength=len(line)))
    if not (x[order] == follows).all():
        raise ValueError("a line of a dense volume has a missing or doubled voxel")
    out = np.zeros((len(line), int(length.max(initial=0))), values.dtype)
    of = np.repeat(np.arange(len(n)), n)
    out[row[of], x[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = values
    return line >> 32, line & 0xFFFFFFFF, out, length


_KEY_TYPES = "vol_id int, z int, y int, xb int"


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def with_values(rows: DataFrame, arrays: list[str], levels: list[str], name: str, kind: str, change: Callable[..., np.ndarray]) -> DataFrame:
    """Brick rows with one array ``name`` that ``change`` makes of others, value by value.

    ``change`` gets the values of ``arrays`` and, for each value, its row's ``levels``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(len(KEYS))
            sizes = first.value_lengths().to_numpy(zero_copy_only=False)
            values = [_flat(batch.column(len(KEYS) + k)) for k in range(len(arrays))]
            steps = [np.repeat(batch.column(len(KEYS) + len(arrays) + k).to_numpy(zero_copy_only=False), sizes) for k in range(len(levels))]
            made = np.ascontiguousarray(change(*values, *steps))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(KEYS)], pa.ListArray.from_arrays(offsets, pa.array(made))], [*KEYS, name])

    return rows.select(*KEYS, *arrays, *levels).mapInArrow(run, f"{_KEY_TYPES}, {name} array<{kind}>")


def runs_where(rows: DataFrame, array: str, level: str, holds: Callable[[np.ndarray, np.ndarray], np.ndarray], whole: bool = True) -> DataFrame:
    """Maximal runs ``(vol_id, z, y, x0, x1)`` of the voxels whose value and row's level fulfil ``holds``.

    Runs are cut in the task that holds the brick; those that meet at a border of bricks are joined, unless ``whole`` is
    false: steps that cut runs at tiles anyway need no shuffle for it.  Nor do lines that fit in one brick.
    """
    from .runs import joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, limit = batch.column(4), batch.column(5).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            inside = np.asarray(holds(_flat(lists), limit[row]), bool)
            edge = np.append(row[1:] != row[:-1], True)[:len(row)]
            ends = inside & (edge | ~np.append(inside[1:], False)[:len(row)])
            edge = np.append(True, edge[:-1])[:len(row)]
            starts = inside & (edge | ~np.append(False, inside[:-1])[:len(row)])
            x = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + batch.column(3).to_numpy().astype(np.int64)[row] * SPAN
            at = pa.array(row[starts])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k).take(at) for k in range(3)), pa.array(x[starts].astype(np.int32)), pa.array(x[ends].astype(np.int32))],
                ["vol_id", "z", "y", "x0", "x1"])

    pieces = rows.select(*KEYS, array, level).mapInArrow(run, "vol_id int, z int, y int, x0 int, x1 int")
    if not whole:
        return pieces
    first, last = rows.agg(F.min("xb"), F.max("xb")).first()
    return pieces if first == last else joined(pieces)


def label_runs(rows: DataFrame, array: str, name: str) -> DataFrame:
    """Stretches ``(vol_id, z, y, x0, x1, name)`` of equal values above zero, cut in the task that holds the brick and at borders of bricks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            row, value = np.repeat(np.arange(len(sizes)), sizes), _flat(lists)
            opens = np.ones(len(row), bool)
            opens[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(row))[:len(first)] - 1
            kept = value[first] > 0
            first, last = first[kept], last[kept]
            x = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + batch.column(3).to_numpy().astype(np.int64)[row] * SPAN
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k).take(at) for k in range(3)), pa.array(x[first].astype(np.int32)), pa.array(x[last].astype(np.int32)),
                pa.array(value[first].astype(np.int32))], ["vol_id", "z", "y", "x0", "x1", name])

    return rows.select(*KEYS, array).mapInArrow(run, f"vol_id int, z int, y int, x0 int, x1 int, {name} int")


def per_volume(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(volume, its first row, its values) of a batch whose first column is ``vol_id``, its second an array."""
    vol_ids = batch.column(0).to_numpy(zero_copy_only=False)
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    values = _flat(batch.column(1))
    if not len(vol_ids):
        return
    order = np.argsort(vol_ids, kind="stable")
    cuts = np.flatnonzero(np.append(True, vol_ids[order][1:] != vol_ids[order][:-1]))
    of_value = np.repeat(vol_ids, sizes)
    for k in cuts:
        row = int(order[k])
        yield int(vol_ids[row]), row, values if len(cuts) == 1 else values[of_value == vol_ids[row]]


def histogram(rows: DataFrame, array: str) -> DataFrame:
    """``(vol_id, value, n)`` of whole numbers: counted per batch, added before and after the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vol_id, _, values in per_volume(batch):
                level, n = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), vol_id, np.int32)), pa.array(level.astype(np.int32)), pa.array(n)], ["vol_id", "value", "n"])

    counted = rows.select("vol_id", array).mapInArrow(run, "vol_id int, value int, n long")
    return counted.groupBy("vol_id", "value").agg(F.sum("n").alias("n"))


def weighted_sums(rows: DataFrame, array: str, name: str) -> DataFrame:
    """Per line the sum of the values and of the values times x + 1, in doubles, added in the order of x."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            v = _flat(batch.column(4)).astype(np.float64)
            x = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + batch.column(3).to_numpy().astype(np.int64)[row] * SPAN
            sums = [np.bincount(row, w, len(sizes)) for w in (v, v * (x + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, sums)], ["vol_id", "z", "y", name, f"{name}x"])

    parts = rows.select(*KEYS, array).mapInArrow(run, f"vol_id int, z int, y int, {name} double, {name}x double")
    return parts.groupBy("vol_id", "z", "y").agg(*(F.sum(c).alias(c) for c in (name, f"{name}x")))


def line_sums(rows: DataFrame, array: str) -> DataFrame:
    """Per line ``n``, ``sum_x``, ``sum_v`` and ``sum_vx`` (values times x + 1) of whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            v = _flat(batch.column(4)).astype(np.int64)
            x = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + batch.column(3).to_numpy().astype(np.int64)[row] * SPAN
            sums = [np.bincount(row, w, len(sizes)).astype(np.int64) for w in (None, x, v, v * (x + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, sums)], ["vol_id", "z", "y", "n", "sum_x", "sum_v", "sum_vx"])

    parts = rows.select(*KEYS, array).mapInArrow(run, "vol_id int, z int, y int, n long, sum_x long, sum_v long, sum_vx long")
    return parts.groupBy("vol_id", "z", "y").agg(*(F.sum(c).alias(c) for c in ("n", "sum_x", "sum_v", "sum_vx")))
