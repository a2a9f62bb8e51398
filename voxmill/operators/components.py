"""Connected components of masks and what builds on them.

Each tile of a volume is labelled on its own (a bounded block of runs); only
pairs of tile components that touch across a tile face meet again, on a table
smaller by the tile surface-to-volume ratio.  Components of any size, such as
the outside background of a whole scan, therefore never gather in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions import tiles
from ..functions.numeric import expand, roots, touching
from ..functions.ranking import number_by_bucket
from ..session import by_block, discard, lookup_join, shuffled, store

TILE = 64
#: Tiles a side of the blocks in which holes are filled, and the widest of them that one task gets whole.
ACROSS, DEALT = 4, 64
#: Runs that one call takes at least.
_ROWS = 1 << 15
#: Both loops at least halve what is left per round.
MOST_ROUNDS = 64

# Per connectivity k: line offsets (dz, dy) ahead in raster order, with the x
# slack within which two runs on these lines touch.
_AHEAD = {
    1: [(0, 1, 0), (1, 0, 0)],
    2: [(0, 1, 1), (1, 0, 1), (1, -1, 0), (1, 1, 0)],
    3: [(0, 1, 1), (1, 0, 1), (1, -1, 1), (1, 1, 1)],
}
_PIECES = pa.schema([*((c, pa.int32()) for c in R.RUN), ("piece", pa.int64()), ("open", pa.bool_()), ("edge", pa.bool_())])
#: In the place of a run's last voxel: the row holds the size of the tile's volume.
_SIZE = -1


def _tile_of(tile: int):
    return [F.floor(F.col(c) / tile).cast("int").alias(t) for c, t in (("z", "tz"), ("y", "ty"), ("x0", "tx"))]


def _cut(mask: DataFrame, tile: int) -> DataFrame:
    """Runs of the mask cut at tile borders; voxel masks count as runs of one."""
    if "x0" not in mask.columns:
        return mask.select(*R.LINE, F.col("x").alias("x0"), F.col("x").alias("x1"))
    first, last = (F.floor(F.col(c) / tile).cast("int") for c in ("x0", "x1"))
    return mask.select(*R.RUN, F.explode(F.sequence(first, last)).alias("t")).select(
        *R.LINE,
        F.greatest("x0", F.col("t") * tile).alias("x0"),
        F.least("x1", F.col("t") * tile + tile - 1).alias("x1"),
    )


def _label_tiles(k: int, tile: int, sized: bool = False):
    """Labels the tiles of a table ``(vol_id, tz, ty, tx, z, y, x0, x1)`` of whole, sorted groups, all in one go.

    A piece is ``open`` if it reaches a face behind which there may be another tile, and on the
    ``edge`` if it reaches a face of its volume.  ``sized`` tables tell the size of every tile's volume;
    runs in other tiles lie outside the volumes and are left out.
    """
    ahead, side = _AHEAD[k], np.int64(tile + 2)

    def label(table: pa.Table) -> pa.Table:
        own = np.zeros(table.num_rows, np.int64)
        own[tiles.group_starts(table, 4)[1:]] = 1
        own = np.cumsum(own)
        tz, ty, tx, z, y, x0, x1 = (c.to_numpy().astype(np.int64) for c in table.columns[1:])
        told = np.flatnonzero(x1 == _SIZE)
        size = np.zeros((3, own[-1] + 1 if len(own) else 0), np.int64)
        size[:, own[told]] = z[told], y[told], x0[told]
        order = np.lexsort((x0, y, z, own))
        order = order[(x1[order] != _SIZE) & ((not sized) | (size[0, own[order]] > 0))]
        own, z, y, x0, x1, tz, ty, tx = (c[order] for c in (own, z, y, x0, x1, tz, ty, tx))
        at = touching([own, z, y], x0, x1)
        last = np.append(at[1:], len(own))[:len(at)] - 1
        z, y, x0, x1 = z[at], y[at], x0[at], x1[last]
        # Places in the tile, with a layer around it: no line beside a tile's is another's.
        line = ((own[at] * side + z - tz[at] * tile + 1) * side + y - ty[at] * tile + 1) * side
        left, right = (x - tx[at] * tile + 1 for x in (x0, x1))
        a, b = [], []
        for dz, dy, slack in ahead:
            target = line + (dz * side + dy) * side
            first = np.searchsorted(line + right, target + left - slack, "left")
            until = np.searchsorted(line + left, target + right + slack, "right")
            row, other = expand(first, until)
            a.append(row)
            b.append(other)
        root = roots(len(z), np.concatenate(a), np.concatenate(b))
        piece = ((z << 21 | y) << 21 | x0)[root]
        leaves, ends = np.zeros(len(z), bool), np.zeros(len(z), bool)
        for low, high, of, n in zip((z, y, x0), (z, y, x1), (tz, ty, tx), size):
            first, last, n = of[at] * tile, of[at] * tile + tile - 1, n[own[at]]
            leaves |= (low == first) & (first > 0) | (high == last) & ((n == 0) | (last < n - 1))
            ends |= (n > 0) & ((low == 0) | (high == n - 1))
        reached = [np.bincount(root, flag, len(z))[root] > 0 for flag in (leaves, ends)]
        found = [pa.array(c.astype(np.int32)) for c in (z, y, x0, x1)]
        return pa.table([table.column(0).take(pa.array(order[at])), *found, pa.array(piece), *map(pa.array, reached)], schema=_PIECES)

    return label


def _sizes(catalog: DataFrame, tile: int) -> DataFrame:
    """The size of its volume for every tile, shaped like a run."""
    rows = catalog.filter("vol_id is not null and least(depth, height, width) > 0")
    for t, side in zip(("tz", "ty", "tx"), ("depth", "height", "width")):
        rows = rows.withColumn(t, F.explode(F.sequence(F.lit(0), F.floor((F.col(side) - 1) / tile).cast("int"))))
    return rows.select("vol_id", "tz", "ty", "tx", F.col("depth").alias("z"), F.col("height").alias("y"), F.col("width").alias("x0"), F.lit(_SIZE).alias("x1"))


def tile_pieces(mask: DataFrame, k: int = 1, tile: int = TILE, catalog: DataFrame | None = None) -> DataFrame:
    """Runs with ``piece``: the first voxel of their component within the tile, whether it is ``open`` and, given the catalog, on the ``edge``.

    A piece that is not open is a component.  The sizes of the catalog go to the tiles as rows of their own.
    """
    block = ["vol_id", "tz", "ty", "tx"]
    names = [*block, "z", "y", "x0", "x1"]
    cut = _cut(mask, tile).select("*", *_tile_of(tile))
    if catalog is not None:
        cut = cut.select(*names).unionByName(_sizes(catalog, tile))
    cut = cut.select(*(F.col(c).cast("int").alias(c) for c in names))
    label = _label_tiles(k, tile, catalog is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tiles.whole_groups(batches, 4):
            yield from label(table).to_batches()

    dealt = by_block(cut, *block).sortWithinPartitions(*block)
    return store(dealt.mapInArrow(run, "vol_id int, z int, y int, x0 int, x1 int, piece long, open boolean, edge boolean"), "pieces")


def _face_pairs(pieces: DataFrame, k: int, tile: int) -> DataFrame:
    """Distinct pairs of pieces of different tiles that touch each other.

    Only runs that reach across a face are asked for, so the rows grow with the faces.
    """
    edge = tile - 1
    located = pieces.select("*", *_tile_of(tile))
    # A run lies in one tile along x; whoever touches it lies there or beside it.
    near = (F.col("z") % tile == 0) | (F.col("y") % tile).isin(0, edge) | (F.col("x0") % tile == 0) | (F.col("x1") % tile == edge)
    b = located.filter(near).select(
        "vol_id", "z", "y", F.col("tx").alias("at"),
        *[F.col(c).alias("_" + c) for c in ("x0", "x1", "piece", "tz", "ty", "tx")],
    )
    steps = F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "s"), o)]) for o in [(0, 0, 1), *_AHEAD[k]]]
    )
    a = located.withColumn("o", F.explode(steps)).select(
        "vol_id",
        (F.col("z") + F.col("o.dz")).alias("z"),
        (F.col("y") + F.col("o.dy")).alias("y"),
        *["x0", "x1", "piece", "tz", "ty", "tx", "o.s"],
    )
    reach = [F.floor(x / tile).cast("int") for x in (F.col("x0") - F.col("s"), F.col("x1") + F.col("s"))]
    leaves = (F.floor(F.col("z") / tile) != F.col("tz")) | (F.floor(F.col("y") / tile) != F.col("ty")) | (F.col("at") != F.col("tx"))
    a = a.withColumn("at", F.explode(F.sequence(*reach))).filter(leaves)
    met = a.join(shuffled(b), [*R.LINE, "at"]).filter(
        "(tz <> _tz or ty <> _ty or tx <> _tx) and x0 - s <= _x1 and _x0 <= x1 + s"
    )
    return met.select(
        "vol_id", F.least("piece", "_piece").alias("a"), F.greatest("piece", "_piece").alias("b")
    ).distinct()


def merge(pairs: DataFrame) -> DataFrame:
    """Smallest member of the component of every node in ``pairs(vol_id, a, b)``.

    Every node that has a smaller neighbour hooks onto its smallest one, chains
    are shortened by doubling, and the graph of the hooks' ends is solved next.
    """
    pairs = store(pairs.filter("a <> b").distinct(), "pairs")
    root, rounds = None, 0
    while not pairs.isEmpty():
        rounds += 1
        if rounds > MOST_ROUNDS:
            raise RuntimeError("merging made no progress")
        hooks = store(
            pairs.groupBy("vol_id", F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks"
        )
        hooks = shorten(hooks)
        tops = pairs.select("vol_id", F.col("a").alias("node")).distinct()
        tops = tops.join(shuffled(hooks), ["vol_id", "node"], "left_anti").withColumn("root", F.col("node"))
        root = hooks.unionByName(tops) if root is None else _follow(root, "root", hooks)
        root = store(root, "roots")
        moved = _follow(_follow(pairs, "a", hooks), "b", hooks)
        before, pairs = pairs, store(
            moved.select("vol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .filter("a <> b")
            .distinct(),
            "pairs",
        )
        discard(before)
    if root is None:
        root = pairs.select("vol_id", F.col("a").alias("node"), F.col("b").alias("root"))
    return root


def _follow(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace ``column`` by its parent where it has one."""
    step = parents.select("vol_id", F.col("node").alias(column), F.col("root").alias("_next"))
    rest = df.columns
    return (
        lookup_join(df, step, ["vol_id", column], "left")
        .withColumn(column, F.coalesce("_next", column))
        .select(*rest)
    )


def shorten(parents: DataFrame) -> DataFrame:
    """Point every node of an acyclic ``(vol_id, node, root)`` table at its end."""
    for _ in range(MOST_ROUNDS):
        further = store(
            lookup_join(
                parents,
                parents.select("vol_id", F.col("node").alias("root"), F.col("root").alias("_next")),
                ["vol_id", "root"],
                "left",
            ),
            "hooks",
        )
        parents = further.select("vol_id", "node", F.coalesce("_next", "root").alias("root"))
        if further.filter("_next is not null").isEmpty():
            return parents
    raise RuntimeError("parents form a cycle")


def components(mask: DataFrame, k: int = 1, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Runs with their ``piece``, and the map ``(vol_id, piece, root)``.

    Joining the two on the piece keeps even a giant component spread out.
    """
    pieces = tile_pieces(mask, k, tile)
    return pieces.drop("open", "edge"), _merged(pieces, pieces.filter("open"), k, tile)


def _merged(pieces: DataFrame, opened: DataFrame, k: int, tile: int) -> DataFrame:
    """The map of the ``pieces``, of which only those that are ``opened`` can touch others."""
    merged = merge(_face_pairs(opened, k, tile)).withColumnRenamed("node", "piece")
    known = pieces.select("vol_id", "piece").distinct()
    mapping = known.join(shuffled(merged), ["vol_id", "piece"], "left").select(
        "vol_id", "piece", F.coalesce("root", "piece").alias("root")
    )
    return store(mapping, "components")


def numbered(mapping: DataFrame) -> DataFrame:
    """Add ``component``: 1..n per volume in raster order of the first voxel."""
    tops = mapping.select("vol_id", "root").distinct()
    tops = number_by_bucket(tops, "root", F.shiftright("root", 42), "component")
    return lookup_join(mapping, tops, ["vol_id", "root"])


def label(mask: DataFrame, k: int = 1, tile: int = TILE) -> DataFrame:
    """Runs ``(vol_id, z, y, x0, x1, component)`` of a mask."""
    pieces, mapping = components(mask, k, tile)
    ids = numbered(mapping).select("vol_id", "piece", "component")
    return lookup_join(pieces, ids, ["vol_id", "piece"]).drop("piece")


def on_border(z0="z", z1="z", y0="y", y1="y", x0="x0", x1="x1"):
    """Touches one of the six faces; needs the catalog columns."""
    return (
        (F.col(z0) == 0)
        | (F.col(z1) == F.col("depth") - 1)
        | (F.col(y0) == 0)
        | (F.col(y1) == F.col("height") - 1)
        | (F.col(x0) == 0)
        | (F.col(x1) == F.col("width") - 1)
    )


def border_voxels(mask: DataFrame, catalog: DataFrame) -> DataFrame:
    rest = mask.columns
    return lookup_join(mask, catalog, ["vol_id"]).filter(on_border(x0="x", x1="x")).select(*rest)


def split_external(mask: DataFrame, catalog: DataFrame, k: int = 1, tile: int = TILE) -> DataFrame:
    """Runs of the mask, cut at tiles, with ``external``: connected to a volume face or not.

    Pieces that reach no other tile are judged where they are labelled, so only the others' runs are shuffled again.
    """
    pieces = tile_pieces(mask, k, tile, catalog)
    closed = pieces.filter("not open").select(*R.RUN, F.col("edge").alias("external"))
    opened = pieces.filter("open")
    if opened.isEmpty():
        return closed
    return closed.unionByName(lookup_join(opened, _external(opened, k, tile), ["vol_id", "piece"]).select(*R.RUN, "external"))


def _external(opened: DataFrame, k: int, tile: int) -> DataFrame:
    """``(vol_id, piece, external)`` of pieces that are ``open``: whether what they are part of is on an edge."""
    mapping = _merged(opened, opened, k, tile)
    touching = opened.groupBy("vol_id", "piece").agg(F.max("edge").alias("_touch"))
    flagged = mapping.join(shuffled(touching), ["vol_id", "piece"])
    whole = store(flagged.groupBy("vol_id", "root").agg(F.max("_touch").alias("external")), "external")
    return lookup_join(mapping, whole, ["vol_id", "root"]).select("vol_id", "piece", "external")


def neighbour_pairs(mask: DataFrame, catalog: DataFrame, steps: dict[int, list[tuple[int, int, int, int]]], tile: int = TILE) -> DataFrame:
    """``(vol_id, k, pairs)``: pairs of a mask voxel and one of its neighbours by ``steps[k]`` in the mask and the volume.

    Runs go to the tiles that they reach, with the steps' reach around them, and are moved and
    met there: one row a run and tile, however many steps.
    """
    moves = {k: {(dz, dy, dx) for dz, dy, dx0, dx1 in of for dx in range(dx0, dx1 + 1)} for k, of in steps.items()}
    every = sorted(set().union(*moves.values()))
    reach = max(abs(c) for move in every for c in move)

    def work(table: pa.Table) -> Iterator[pa.Table]:
        own, starts = tiles.numbers_of(table, 4), tiles.group_starts(table, 4)
        vol_id = table["vol_id"].to_numpy()[starts]
        first = np.stack([table[t].to_numpy()[starts].astype(np.int64) * tile for t in ("tz", "ty", "tx")])
        z, y, x0, x1 = (table[c].to_numpy().astype(np.int64) for c in ("z", "y", "x0", "x1"))
        told = np.flatnonzero(x1 == _SIZE)
        size = np.zeros((3, len(starts)), np.int64)
        size[:, own[told]] = z[told], y[told], x0[told]
        rows = np.flatnonzero((x1 != _SIZE) & (size[0, own] > 0))
        offsets = np.append(0, np.cumsum(x1[rows] - x0[rows] + 1))
        ones = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ones(offsets[-1], np.uint8)))
        for groups, cube, low in tiles.cubes(own[rows], z[rows], y[rows], x0[rows], ones):
            inner, inside = cube > 0, cube > 0
            for axis, n in enumerate(cube.shape[1:]):
                at = (low[:, axis, None] + np.arange(n)).reshape([-1, *(n if i == axis else 1 for i in range(3))])
                start, side = (c[axis, groups][:, None, None, None] for c in (first, size))
                inner &= (at >= start) & (at < start + tile)
                inside &= (at >= 0) & (at < side)
            pairs = {}
            for move in every:
                if any(abs(d) >= n for d, n in zip(move, cube.shape[1:])):
                    pairs[move] = np.zeros(len(groups), np.int64)
                    continue
                a = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(move, cube.shape[1:]))
                b = tuple(slice(max(0, d), n + min(0, d)) for d, n in zip(move, cube.shape[1:]))
                pairs[move] = np.count_nonzero(inner[:, *a] & inside[:, *b], axis=(1, 2, 3))
            for k, of in moves.items():
                n = sum(pairs[move] for move in of)
                some = n > 0
                yield pa.table({"vol_id": pa.array(vol_id[groups][some].astype(np.int32)), "k": pa.array(np.full(some.sum(), k, np.int32)), "pairs": pa.array(n[some].astype(np.int64))})

    reached = {t: F.sequence(F.greatest(F.lit(0), F.floor((F.col(a) - reach) / tile)).cast("int"), F.floor((F.col(b) + reach) / tile).cast("int"))
               for t, a, b in (("tz", "z", "z"), ("ty", "y", "y"), ("tx", "x0", "x1"))}
    near = mask.select(*R.RUN).filter(F.least(F.col("z"), F.col("y"), F.col("x1")) >= -reach)
    for t, of in reached.items():
        near = near.withColumn(t, F.explode(of))
    near = near.withColumns({"x0": F.greatest("x0", F.col("tx") * tile - reach), "x1": F.least("x1", F.col("tx") * tile + (tile - 1 + reach))})
    names = ["vol_id", "tz", "ty", "tx", "z", "y", "x0", "x1"]
    dealt = near.select(*(F.col(c).cast("int").alias(c) for c in names)).unionByName(
        _sizes(catalog, tile).select(*(F.col(c).cast("int").alias(c) for c in names)))
    counted = tiles.in_tables(dealt, work, "vol_id int, k int, pairs long", _ROWS)
    return counted.groupBy("vol_id", "k").agg(F.sum("pairs").alias("pairs"))


def _background(line, x0, x1, wide) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches ``(line, from, until)`` of lines 0..n-1 of ``wide`` voxels each that no run covers; runs by line, places from 0 on."""
    n = len(wide)
    every = np.arange(n)
    at, start, end = (np.concatenate(c) for c in ((every, line, every), (np.full(n, -1), x0, wide), (np.full(n, -1), x1, wide)))
    order = np.lexsort((start, at))
    at, start, end = at[order], start[order], end[order]
    side = int(end.max(initial=0)) + 2
    free = np.maximum.accumulate(at * side + end + 1) - at * side
    gap = np.flatnonzero((at[1:] == at[:-1]) & (free[:-1] < start[1:]))
    return at[gap], free[gap], start[gap + 1]


def _pieces(of, z, y, x0, x1, vol_id: pa.ChunkedArray, corner: np.ndarray, size: np.ndarray, tile: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``piece``, ``open`` and ``edge`` of runs of many blocks of ``side`` voxels, sorted by block and place and cut at tiles.

    Tiles are labelled one by one, then pieces that touch across the faces of the tiles of a block are made one.
    """
    of_tile = [c // tile for c in (z, y, x0)]
    order = np.lexsort((x0, y, z, *of_tile[::-1], of))
    # Every tile begins with the row that tells the size of its volume; runs that do not touch keep their order.
    sorted_ = [c[order] for c in (of, *of_tile)]
    begins = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in sorted_], axis=0))[:len(order)])
    row = np.insert(order, begins, order[begins])
    told = begins + np.arange(len(begins))
    keys = [vol_id.take(pa.array(of[row])), *(pa.array(c[row].astype(np.int32)) for c in of_tile)]
    places = [c[row] for c in (z, y, x0, x1)]
    for place, c in zip(places, (*size[:, of[order[begins]]], _SIZE)):
        place[told] = c
    found = _label_tiles(1, tile, True)(pa.table([*keys, *(pa.array(c.astype(np.int32)) for c in places)], ["vol_id", "tz", "ty", "tx", "z", "y", "x0", "x1"]))
    first = np.empty(len(of), np.int64)
    first[order] = found["piece"].to_numpy()

    order = np.lexsort((first, of))
    opens = np.append(True, (first[order][1:] != first[order][:-1]) | (of[order][1:] != of[order][:-1]))[:len(of)]
    node = np.empty(len(of), np.int64)
    node[order] = np.cumsum(opens) - 1
    n = int(opens.sum())
    if side > tile:
        wide = np.int64(side + 2)
        line = ((of * wide + z - corner[0, of] + 1) * wide + y - corner[1, of] + 1) * wide + 1 - corner[2, of]
        left, right = line + x0, line + x1
        met = np.flatnonzero(left[1:] == right[:-1] + 1)
        a, b = [met], [met + 1]
        for c, step in ((y, wide), (z, wide * wide)):
            rows = np.flatnonzero((c + 1) % tile == 0)
            k, other = expand(np.searchsorted(right, left[rows] + step, "left"), np.searchsorted(left, right[rows] + step, "right"))
            a.append(rows[k])
            b.append(other)
        root = roots(n, node[np.concatenate(a)], node[np.concatenate(b)])[node]
    else:
        root = node
    leaves, ends = np.zeros(len(of), bool), np.zeros(len(of), bool)
    for low, high, start, m in zip((z, y, x0), (z, y, x1), corner[:, of], size[:, of]):
        leaves |= (low == start) & (start > 0) | (high == start + side - 1) & (start + side < m)
        ends |= (low == 0) | (high == m - 1)
    opened, edge = (np.bincount(root, flag, n)[root] > 0 for flag in (leaves, ends))
    return first[order[opens]][root], opened, edge


def _fill_tiles(tile: int, side: int):
    """Fills the closed holes of the blocks of ``side`` voxels of a table like that of ``_label_tiles``: runs of kind 0 (final),
    1 (may be joined beyond their block or with a hole) and 2 (pieces of the background that are open)."""
    wide = np.int64(side + 2)

    def work(table: pa.Table) -> Iterator[pa.Table]:
        own, starts = tiles.numbers_of(table, 4), tiles.group_starts(table, 4)
        corner = np.stack([table[t].to_numpy()[starts].astype(np.int64) * side for t in ("tz", "ty", "tx")])
        z, y, x0, x1 = (table[c].to_numpy().astype(np.int64) for c in ("z", "y", "x0", "x1"))
        told = np.flatnonzero(x1 == _SIZE)
        size = np.zeros_like(corner)
        size[:, own[told]] = z[told], y[told], x0[told]
        run = np.flatnonzero(x1 != _SIZE)
        group, z, y, x0, x1 = (c[run] for c in (own, z, y, x0, x1))
        n = np.maximum(np.minimum(corner + side, size) - corner, 0)
        lines = np.where(n[2] > 0, n[0] * n[1], 0)
        base = np.cumsum(lines) - lines
        of, k = expand(np.zeros_like(lines), lines)
        dz, dy, dx = z - corner[0, group], y - corner[1, group], x0 - corner[2, group]
        inside = (dz < n[0, group]) & (dy < n[1, group]) & (dx < n[2, group])
        line = (base[group] + dz * n[1, group] + dy)[inside]
        line, first, until = _background(line, dx[inside], (x1 - corner[2, group])[inside], n[2, of])
        gap, part = expand(first // tile, (until - 1) // tile + 1)
        line, first, until = line[gap], np.maximum(first[gap], part * tile), np.minimum(until[gap], (part + 1) * tile)
        of, k = of[line], k[line]
        bz, by, b0, b1 = corner[0, of] + k // n[1, of], corner[1, of] + k % n[1, of], corner[2, of] + first, corner[2, of] + until - 1
        piece, opened, edge = _pieces(of, bz, by, b0, b1, table.column(0).take(pa.array(starts)), corner, size, tile, side)

        hole = ~opened & ~edge
        group, z, y, x0, x1 = (np.concatenate([c, b[hole]]) for c, b in zip((group, z, y, x0, x1), (of, bz, by, b0, b1)))
        order = np.lexsort((x0, y, z, group))
        group, z, y, x0, x1 = (c[order] for c in (group, z, y, x0, x1))

        def code(group, z, y, x):
            return (((group * wide + z - corner[0, group]) * wide + y - corner[1, group]) * wide) + x - corner[2, group] + 1

        left, right = code(group, z, y, x0), code(group, z, y, x1)
        reach = np.maximum.accumulate(right)
        # The layer of one on both sides keeps runs of neighbouring lines apart.
        opens = np.append(True, left[1:] > reach[:-1] + 1)[:len(left)]
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(left))[:len(at)] - 1
        group, z, y, x0, left, right = group[at], z[at], y[at], x0[at], left[at], reach[last]
        x1 = x0 + right - left
        start, width = corner[2, group], size[2, group]
        loose = (width == 0) | (x0 == start) & (start > 0) | (x1 == start + side - 1) & (x1 < width - 1)
        loose |= np.isin(right + 1, code(of, bz, by, b0)[opened]) | np.isin(left - 1, code(of, bz, by, b1)[opened])
        rows = {"z": (z, bz), "y": (y, by), "x0": (x0, b0), "x1": (x1, b1)}
        whose = np.concatenate([starts[group], starts[of][opened]])
        yield pa.table({
            "vol_id": table.column(0).take(pa.array(whose)),
            **{c: pa.array(np.concatenate([a, b[opened]]).astype(np.int32)) for c, (a, b) in rows.items()},
            "piece": pa.array(np.concatenate([np.zeros(len(z), np.int64), piece[opened]])),
            "edge": pa.array(np.concatenate([np.zeros(len(z), bool), edge[opened]])),
            "kind": pa.array(np.concatenate([loose.astype(np.int32), np.full(opened.sum(), 2, np.int32)]))})

    return work


def fill_holes(mask: DataFrame, catalog: DataFrame, tile: int = TILE) -> DataFrame:
    """Mask runs plus the background that is cut off from every volume face.

    A tile tells its background by itself, fills the holes that do not leave it, and joins runs;
    small blocks of tiles are dealt whole and do so together.  Only open pieces of the background and
    the runs that may be joined with them or beyond the tile are shuffled again.
    """
    side = tile * ACROSS if tile * ACROSS <= DEALT else tile
    names = ["vol_id", "tz", "ty", "tx", "z", "y", "x0", "x1"]
    cut = _cut(mask, side).select("*", *_tile_of(side)).select(*names).unionByName(_sizes(catalog, side).select(*names))
    cut = cut.select(*(F.col(c).cast("int").alias(c) for c in names))
    schema = "vol_id int, z int, y int, x0 int, x1 int, piece long, edge boolean, kind int"
    filled = store(tiles.in_tables(cut, _fill_tiles(tile, side), schema, _ROWS), "filled")
    final, loose, opened = (filled.filter(f"kind = {k}") for k in range(3))
    loose = loose.select(*R.RUN)
    if not opened.isEmpty():
        holes = _external(opened, 1, side).filter("not external").select("vol_id", "piece")
        loose = loose.unionByName(lookup_join(opened, holes, ["vol_id", "piece"]).select(*R.RUN))
    return final.select(*R.RUN).unionByName(R.joined(loose))


def drop_small(mask: DataFrame, min_size: int, tile: int = TILE) -> DataFrame:
    """Mask runs of components with at least ``min_size`` voxels."""
    pieces, mapping = components(mask, 1, tile)
    sizes = pieces.groupBy("vol_id", "piece").agg(F.sum(R.length()).alias("_n"))
    whole = mapping.join(shuffled(sizes), ["vol_id", "piece"]).groupBy("vol_id", "root").agg(F.sum("_n").alias("_n"))
    whole = store(whole.filter(F.col("_n") >= min_size).select("vol_id", "root"), "large")
    kept = lookup_join(mapping, whole, ["vol_id", "root"]).select("vol_id", "piece")
    return lookup_join(pieces, kept, ["vol_id", "piece"]).select(*R.RUN)


def restrict_markers(markers: DataFrame, foreground: DataFrame, tile: int = TILE) -> DataFrame:
    """Marker runs inside the foreground, labelled anew by 6-connectivity."""
    return label(R.overlap(markers.select(*R.RUN), foreground.select(*R.RUN)), 1, tile)


def drop_small_labels(labels: DataFrame, min_size: int) -> DataFrame:
    """Labels of at least ``min_size`` voxels, renumbered 1..n in id order."""
    size = R.length() if "x0" in labels.columns else F.lit(1).cast("long")
    sizes = labels.filter("label > 0").groupBy("vol_id", "label").agg(F.sum(size).alias("_n"))
    kept = sizes.filter(F.col("_n") >= min_size).select("vol_id", "label")
    ids = number_by_bucket(kept, "label", F.shiftright(F.col("label").cast("long"), 16), "_new")
    rest = [c for c in labels.columns if c != "label"]
    return lookup_join(labels, ids, ["vol_id", "label"]).select(*rest, F.col("_new").alias("label"))
