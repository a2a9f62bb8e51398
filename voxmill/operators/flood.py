"""Marker-controlled flooding of the negated distance map.

Foreground voxels are nodes, 6-neighbour pairs edges.  An edge weighs
``(max(a_u, a_v), min(a_u, a_v), lower position, higher position)`` with
``a = -d2``: a total order, so the spanning forest rooted at the markers is
unique and does not depend on partitioning (minimum spanning forests as
watershed cuts: Cousty, Bertrand, Najman, Couprie, PAMI 2009).

Every fragment without marker joins over its lightest outgoing edge.  Within a
tile this runs until each fragment's lightest edge leaves the tile, then likewise on
the fragments of a block of tiles; the rounds over a volume work on what is left.
Distances reach a tile as packed stretches of lines, with a layer of its neighbours;
small blocks of tiles are dealt whole.  One call works on all tiles of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions import tiles
from ..functions.bricks import SPAN
from ..functions.numeric import FAR, expand
from ..functions.ranking import number_in_order
from ..functions.tiles import BLOCK
from ..session import discard, lookup_join, store, union_all
from .components import _follow, shorten
from .select import suppress

#: Tiles a side of the blocks in which fragments are joined before the rounds over a whole volume.
ACROSS = 4
#: Widest blocks that one task gets whole, so that no edge between their tiles is shuffled.
DEALT = 64
#: Values, and rows of links, that one call takes at least.
_VALUES, _LINKS = 1 << 20, 1 << 18
_OUT = (
    "vol_id int, kind int, z int, y int, x0 int, x1 int, frag long, label long, "
    "w1 long, w2 long, lo long, hi long"
)
_OUT_ARROW = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in (f.split() for f in _OUT.split(", "))])


def _position(z, y, x):
    return (z << 42) | (y << 21) | x


def lightest_edges(n: int, u: np.ndarray, v: np.ndarray, rooted: np.ndarray, frag: np.ndarray | None = None) -> np.ndarray:
    """Fragment of each of ``n`` nodes once no free fragment can join inside.

    Edges are sorted by weight; ``v`` is -1 where the other end lies outside.
    A rooted fragment never moves; a free one follows its lightest edge unless
    that edge leads outside.  ``frag`` holds the fragments to begin with.
    """
    frag = np.arange(n) if frag is None else frag
    while True:
        fu, fv = frag[u], np.where(v >= 0, frag[v], -1)
        open_ = (fu != fv) & ~(rooted[fu] & ((fv < 0) | rooted[fv]))
        u, v, fu, fv = u[open_], v[open_], fu[open_], fv[open_]
        # The first edge of a fragment is its lightest: of equal places the last one assigned stays.
        best = np.full(n, len(u))
        position = np.arange(len(u))
        ends = np.stack([fu, np.where(fv >= 0, fv, fu)], 1).reshape(-1)[::-1]
        best[ends] = np.repeat(position, 2)[::-1]
        movers = np.flatnonzero((best < len(u)) & ~rooted)
        edge = best[movers]
        target = np.where(fu[edge] == movers, fv[edge], fu[edge])
        inside = target >= 0
        movers, target = movers[inside], target[inside]
        if not len(movers):
            return frag
        up = np.arange(n)
        up[movers] = target
        mutual = movers[(up[target] == movers) & (movers < target)]
        up[mutual] = mutual
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
        frag = up[frag]


def _contract(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join fragments inside blocks; ``u, v`` are nodes, ``v`` -1 outside, edges sorted by weight.

    Edges that are ``apart`` lead to another tile of the block: fragments are joined inside the
    tiles first.  Returns the fragment of each node, and (node, edge) of the ends of all edges
    that stay open: those to the outside, and the lightest one between two fragments that are
    not both rooted.
    """
    rooted, frag = labels > 0, None
    if apart is not None and apart.any():
        # An edge between tiles leads outside for both of them.
        twice = np.where(apart, 2, 1)
        edge = np.repeat(np.arange(len(u)), twice)
        second = np.append(False, edge[1:] == edge[:-1])
        frag = lightest_edges(n, np.where(second, v[edge], u[edge]), np.where(apart[edge], -1, v[edge]), rooted)
    frag = lightest_edges(n, u, v, rooted, frag)
    fu, fv = frag[u], np.where(v >= 0, frag[v], -1)
    outer = v < 0
    inner = np.flatnonzero((fu != fv) & ~outer & ~(rooted[fu] & rooted[fv]))
    pair = np.minimum(fu, fv)[inner] * np.int64(n) + np.maximum(fu, fv)[inner]
    inner = inner[np.sort(np.unique(pair, return_index=True)[1])]
    outer = np.flatnonzero(outer)
    return frag, np.concatenate([fu[outer], fu[inner], fv[inner]]), np.concatenate([outer, inner, inner])


def _table(filled: dict[str, np.ndarray], links: dict[str, np.ndarray]) -> pa.Table:
    """Rows of kind 0 (``filled``) and 1 (``links``); columns that a kind lacks are 0."""
    n, m = len(filled["frag"]), len(links["frag"])
    columns = {"kind": np.repeat([0, 1], [n, m])}
    for field in _OUT_ARROW:
        if field.name not in columns:
            columns[field.name] = np.concatenate([part.get(field.name, np.zeros(size, np.int64)) for part, size in ((filled, n), (links, m))])
    return pa.table({f.name: pa.array(columns[f.name].astype(f.type.to_pandas_dtype())) for f in _OUT_ARROW}, schema=_OUT_ARROW)


def _by_weight(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Order of edges, given by position, by their weight: the larger of the lesser distances first, then of the greater."""
    top = int(high.max(initial=0))
    if top < 1 << 16:
        seen = np.zeros(top + 1, bool)
        seen[low] = seen[high] = True
        level = np.cumsum(seen[::-1])[::-1] - 1
        n, low, high = int(seen.sum()), level[low], level[high]
    else:
        values = np.unique(np.concatenate([low, high]))
        n, low, high = len(values), np.searchsorted(values, low), np.searchsorted(values, high)
        low, high = n - 1 - low, n - 1 - high
    key = low.astype(np.int64) * n + high
    return np.argsort(key.astype(np.uint16) if n <= 256 else key, kind="stable")


def _flood_tiles(tile: int, side: int):
    """Floods a table of whole blocks of ``side`` voxels, first inside their tiles of ``tile``."""
    def flood(cube: np.ndarray, low: np.ndarray, own: np.ndarray, vol_id: np.ndarray, marks: tuple[np.ndarray, ...]) -> pa.Table:
        axes = [(low[:, k, None] + np.arange(m)).reshape([-1, *(m if i == k else 1 for i in range(3))]) for k, m in enumerate(cube.shape[1:])]
        core = cube > 0
        for ax, start in zip(axes, own.T):
            start = start[:, None, None, None]
            core &= (ax >= start) & (ax < start + side)
        of, *at = np.nonzero(core)
        n = len(of)
        node = np.full(cube.shape, -1)
        node[core] = np.arange(n)
        kz, ky, kx = (c + low[of, k] for k, c in enumerate(at))
        place = _position(kz, ky, kx)
        labels = np.zeros(n, np.int64)
        group, *there, label = marks
        there = [c - low[group, k] for k, c in enumerate(there)]
        inside = np.logical_and.reduce([(c >= 0) & (c < m) for c, m in zip(there, cube.shape[1:])])
        marked = node[(group[inside], *(c[inside] for c in there))]
        labels[marked[marked >= 0]] = label[inside][marked >= 0]

        # Edges stand under their first voxel, along x, y, z: in the order of both positions.
        filled, met = cube > 0, np.zeros((*cube.shape, 3), bool)
        for k, axis in enumerate((3, 2, 1)):
            a = tuple(slice(None, -1) if i == axis else slice(None) for i in range(4))
            b = tuple(slice(1, None) if i == axis else slice(None) for i in range(4))
            met[(*a, k)] = filled[a] & filled[b] & (core[a] | core[b])
        first, along = np.divmod(np.flatnonzero(met), 3)
        second = first + np.array([1, cube.shape[3], cube.shape[2] * cube.shape[3]])[along]
        da, db = cube.reshape(-1)[first], cube.reshape(-1)[second]
        order = _by_weight(np.minimum(da, db), np.maximum(da, db))
        first, second = first[order], second[order]
        na, nb = node.reshape(-1)[first], node.reshape(-1)[second]
        u, v = np.where(na >= 0, na, nb), np.where(na >= 0, nb, -1)
        apart = None
        if tile < side:
            own_tile = (kz // tile << 42) | (ky // tile << 21) | kx // tile
            apart = (v >= 0) & (own_tile[u] != own_tile[v])
        frag, end, edge = _contract(n, u, v, labels, apart)

        starts = np.ones(n, bool)
        starts[1:] = (frag[1:] != frag[:-1]) | (of[1:] != of[:-1]) | (kx[1:] != kx[:-1] + 1) | (ky[1:] != ky[:-1]) | (kz[1:] != kz[:-1])
        ends = np.append(starts[1:], True)[:n]
        runs = {"vol_id": vol_id[of[starts]], "z": kz[starts], "y": ky[starts], "x0": kx[starts], "x1": kx[ends], "frag": place[frag[starts]], "label": labels[frag[starts]]}
        da, db = cube.reshape(-1)[first[edge]], cube.reshape(-1)[second[edge]]
        ends = [np.unravel_index(f[edge], cube.shape) for f in (first, second)]
        lo, hi = (_position(*(c + low[e[0], k] for k, c in enumerate(e[1:]))) for e in ends)
        return _table(runs, {"vol_id": vol_id[of[end]], "frag": place[end], "label": labels[end], "w1": -np.minimum(da, db), "w2": -np.maximum(da, db), "lo": lo, "hi": hi})

    def work(table: pa.Table) -> Iterator[pa.Table]:
        group = tiles.numbers_of(table, 4)
        starts = tiles.group_starts(table, 4)
        vol_id = table["vol_id"].to_numpy()[starts]
        own = np.stack([table[t].to_numpy()[starts].astype(np.int64) * side for t in BLOCK[1:]], 1)
        z, y, x0, x1, label = (table[c].to_numpy().astype(np.int64) for c in ("z", "y", "x0", "x1", "label"))
        mark = np.flatnonzero(label > 0)
        rows = np.flatnonzero(label <= 0)
        run, x = expand(x0[mark], x1[mark] + 1)
        run = mark[run]
        lists = table["v"].combine_chunks().take(pa.array(rows))
        local = np.full(len(starts), -1)
        for groups, cube, low in tiles.cubes(group[rows], z[rows], y[rows], x0[rows], lists):
            local[groups] = np.arange(len(groups))
            here = local[group[run]] >= 0
            at = run[here]
            yield flood(cube, low, own[groups], vol_id[groups], (local[group[at]], z[at], y[at], x[here], label[at]))
            local[groups] = -1

    return work


def _flood_blocks(table: pa.Table) -> Iterator[pa.Table]:
    """The same for the fragments of blocks of tiles: kind 0 maps ``lo`` to ``frag``."""
    group = tiles.numbers_of(table, 4)
    vol_id = table["vol_id"].to_numpy()
    own, label, w1, w2, lo, hi = (table[c].to_numpy() for c in ("frag", "label", "w1", "w2", "lo", "hi"))
    order = np.lexsort((own, group))
    opens = np.ones(len(order), bool)
    opens[1:] = (own[order][1:] != own[order][:-1]) | (group[order][1:] != group[order][:-1])
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(opens) - 1
    name, vol = own[order[opens]], vol_id[order[opens]]
    labels = np.zeros(len(name), np.int64)
    labels[node] = label
    # The two ends of an edge stand one behind the other; an edge seen once leads outside.
    order = np.lexsort((node, hi, lo, group))
    node, w1, w2, lo, hi, group = (c[order] for c in (node, w1, w2, lo, hi, group))
    first = np.ones(len(node), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(first)
    paired = np.append(~first[1:], False)[at]
    v = np.where(paired, node[np.minimum(at + 1, len(node) - 1)], -1)
    rank = np.lexsort((hi[at], lo[at], w2[at], w1[at]))
    at, v = at[rank], v[rank]
    frag, end, edge = _contract(len(name), node[at], v, labels)
    edge = at[edge]
    yield _table({"vol_id": vol, "lo": name, "frag": name[frag], "label": labels[frag]},
                 {"vol_id": vol[end], "frag": name[end], "label": labels[end], "w1": w1[edge], "w2": w2[edge], "lo": lo[edge], "hi": hi[edge]})


def _join_fragments(links: DataFrame) -> DataFrame:
    """``(vol_id, node, root, label)`` of all fragments that have open edges.

    Each round's tables are deleted once the next ones are stored.
    """
    edges = links.groupBy("vol_id", "lo", "hi", "w1", "w2").agg(
        F.min("frag").alias("a"), F.max("frag").alias("b")
    )
    labels = store(links.groupBy("vol_id", F.col("frag").alias("node")).agg(F.max("label").alias("label")), "labels")
    state = labels.withColumn("root", F.col("node"))
    open_edges, old_state = None, None
    while True:
        edges = store(_open_edges(edges, labels), "edges")
        discard(open_edges)
        open_edges = edges
        if edges.isEmpty():
            break
        ends = F.explode(
            F.array(
                F.struct(F.col("a").alias("node"), F.col("b").alias("to"), F.col("la").alias("l")),
                F.struct(F.col("b").alias("node"), F.col("a").alias("to"), F.col("lb").alias("l")),
            )
        ).alias("e")
        lightest = F.min(F.struct("w1", "w2", "lo", "hi", "e.to")).alias("pick")
        picks = edges.select("*", ends).filter("e.l = 0").groupBy("vol_id", "e.node").agg(lightest)
        picks = store(picks.select("vol_id", "node", F.col("pick.to").alias("root")), "picks")
        back = picks.select("vol_id", F.col("node").alias("root"), F.col("root").alias("_back"))
        one_way = lookup_join(picks, back, ["vol_id", "root"], "left").filter(
            "_back is null or _back <> node or node > root"
        )
        hooks = store(shorten(store(one_way.select("vol_id", "node", "root"), "hooks")), "hooks")
        state = store(_follow(state, "root", hooks), "fragments")
        discard(old_state, picks)
        old_state = state
        labels = labels.join(hooks, ["vol_id", "node"], "left_anti")
        labels = store(labels, "labels")
        edges = _follow(_follow(edges, "a", hooks), "b", hooks).drop("la", "lb")
    named = labels.select("vol_id", F.col("node").alias("root"), "label")
    return lookup_join(state.drop("label"), named, ["vol_id", "root"])


def _in_blocks(links: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """One contraction per block of ``ACROSS`` tiles a side: ``(vol_id, node, root, label)``, and the links left.

    A block holds at most the open edges of that many tiles.  A fragment is named by a voxel of its tile.
    """
    side = tile * ACROSS
    axis = [F.shiftright("frag", 42), F.shiftright("frag", 21).bitwiseAND(F.lit((1 << 21) - 1)), F.col("frag").bitwiseAND(F.lit((1 << 21) - 1))]
    boxed = links.withColumns({t: F.floor(a / side).cast("int") for t, a in zip(BLOCK[1:], axis)})
    out = store(tiles.in_tables(boxed, _flood_blocks, _OUT, _LINKS), "blocks")
    mapped = out.filter("kind = 0").select("vol_id", F.col("lo").alias("node"), F.col("frag").alias("root"), "label")
    return mapped, out.filter("kind = 1")


def _open_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Lightest edge per fragment pair, without pairs that can no longer join."""
    weight = F.struct("w1", "w2", "lo", "hi")
    lightest = (
        edges.filter("a <> b")
        .groupBy("vol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.min(weight).alias("w"))
        .select("vol_id", "a", "b", "w.*")
    )
    for end in ("a", "b"):
        side = labels.select("vol_id", F.col("node").alias(end), F.col("label").alias("l" + end))
        lightest = lookup_join(lightest, side, ["vol_id", end])
    return lightest.filter("la = 0 or lb = 0")


def flood(distance_rows: DataFrame, markers: DataFrame, tile: int = 64) -> DataFrame:
    """Label runs ``(vol_id, z, y, x0, x1, label)`` of the flooded foreground.

    ``markers`` are runs with ``component``.  Foreground that no marker reaches
    stays out of the result.
    """
    side = tile * ACROSS if tile * ACROSS <= DEALT and SPAN % (tile * ACROSS) == 0 else tile
    seeds = tiles.cut(markers, side, F.col("component").cast("long").alias("label"))
    rows = tiles.exchange(distance_rows, "d2", side, corners=False)
    # Markers ride along as runs without values; both meet inside the tile.
    shape = ["vol_id", "tz", "ty", "tx", "z", "y", "x0", "x1", "label", "v"]
    boxed = union_all(
        rows.withColumns({"x1": F.lit(0), "label": F.lit(0).cast("long")}).select(*shape),
        seeds.withColumn("v", F.lit(None).cast("array<bigint>")).select(*shape),
    )
    tiled = store(tiles.in_tables(boxed, _flood_tiles(tile, side), _OUT, _VALUES // min(side, SPAN)), "flooded")
    filled = tiled.filter("kind = 0").select(*R.RUN, "frag", "label")
    mapped, left = None, tiled.filter("kind = 1")
    if side == tile:
        mapped, left = _in_blocks(left, tile)
    joined = _join_fragments(left).select("vol_id", "root", F.col("node"), F.col("label").alias("_label"))
    named = joined.select("vol_id", F.col("node").alias("frag"), "_label")
    if mapped is not None:
        final = joined.select("vol_id", F.col("node").alias("root"), "_label")
        named = lookup_join(mapped, final, ["vol_id", "root"], "left").select(
            "vol_id", F.col("node").alias("frag"), F.coalesce("_label", "label").alias("_label")
        )
    return (
        lookup_join(filled, named, ["vol_id", "frag"], "left")
        .select(*R.RUN, F.coalesce("_label", "label").alias("label"))
        .filter("label > 0")
    )


def _tops_of_tiles(tile: int):
    def tops(cube: np.ndarray, low: np.ndarray, own: np.ndarray, vol_id: np.ndarray) -> pa.Table:
        around = cube
        for axis in (1, 2, 3):  # the maximum of three neighbours, one axis after the other
            wide = np.pad(around, [(1, 1) if i == axis else (0, 0) for i in range(4)])
            n = cube.shape[axis]
            around = np.maximum.reduce([wide[(slice(None),) * axis + (slice(k, k + n),)] for k in range(3)])
        of, *at = np.nonzero((cube > 0) & (cube == around) & (cube < FAR))
        place = [c + low[of, k] for k, c in enumerate(at)]
        inner = np.logical_and.reduce([(c >= own[of, k]) & (c < own[of, k] + tile) for k, c in enumerate(place)])
        columns = [("vol_id", vol_id[of]), *zip("zyx", place)]
        return pa.table({n: pa.array(c[inner].astype(np.int32)) for n, c in columns} | {"d2": pa.array(cube[(of, *at)][inner])})

    def work(table: pa.Table) -> Iterator[pa.Table]:
        starts = tiles.group_starts(table, 4)
        vol_id = table["vol_id"].to_numpy()[starts]
        own = np.stack([table[t].to_numpy()[starts].astype(np.int64) * tile for t in BLOCK[1:]], 1)
        z, y, x0 = (table[c].to_numpy() for c in ("z", "y", "x0"))
        for groups, cube, low in tiles.cubes(tiles.numbers_of(table, 4), z, y, x0, table["v"].combine_chunks()):
            yield tops(cube, low, own[groups], vol_id[groups])

    return work


def peaks(distance_rows: DataFrame, min_distance: int, tile: int = 64) -> DataFrame:
    """Markers at distance maxima at least ``min_distance`` apart.

    Own rule: a voxel is a candidate when none of its 26 neighbours is farther
    from the background; candidates are taken by (distance desc, position).
    Tiles with one layer of their neighbours take a running maximum per axis.
    """
    boxed = tiles.exchange(distance_rows, "d2", tile, corners=True)
    tops = tiles.in_tables(boxed, _tops_of_tiles(tile), "vol_id int, z int, y int, x int, d2 long", _VALUES // min(tile, SPAN))
    tops = store(tops.withColumn("place", R.place(x="x")), "tops")
    kept = suppress(tops, min_distance, [F.col("d2").desc(), F.col("place")])
    ranked = number_in_order(kept, [F.col("place").asc()], "component")
    return ranked.select("vol_id", "z", "y", F.col("x").alias("x0"), F.col("x").alias("x1"), "component")
