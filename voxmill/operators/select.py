"""Rule cascades over component features and spatial suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import runs as R
from ..functions import tiles
from ..functions.ranking import number_in_order
from ..functions.tiles import BLOCK
from ..params import REJECT_MARKER, REJECT_SEED, SEED_POINT_VALUE, MarkerRules, Sampling, SeedRules
from ..session import discard, lookup_join, store, union_all
from . import features as feat

ID = feat.ID


#: Least side of the tiles in which points are judged.
TILE = 64
#: Points that one call takes at least.
_ROWS = 1 << 16
_POINT = "vol_id int, z int, y int, x int, rank long, kept boolean"


def _judge_tiles(side: int, reach: int, min_dist: float, shift: int):
    """Greedy choice among the points of each tile of a table and those within reach around it.

    By rank a point is gone if a kept one is near, open if an open one is near (or if it
    lies outside and its own tile has not decided), and else kept.
    """
    steps = np.arange(-reach, reach + 1)
    ball = (steps[:, None, None] ** 2 + steps[None, :, None] ** 2 + steps[None, None, :] ** 2) < min_dist * min_dist

    def judge(at: np.ndarray, kept: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = at - at.min(axis=1)[:, None]
        # One byte a voxel around the points: 1 near a kept point, 2 near an open one.
        near = np.zeros(tuple(at.max(axis=1) + 2 * reach + 1), np.uint8)
        flags = memoryview(near.reshape(-1))
        centre = np.ravel_multi_index(tuple(at + reach), near.shape).tolist()
        places = at.T.tolist()

        def mark(k: int, flag: int) -> None:
            z, y, x = places[k]
            box = near[z:z + 2 * reach + 1, y:y + 2 * reach + 1, x:x + 2 * reach + 1]
            box[ball] |= flag

        for k in np.flatnonzero(kept).tolist():
            mark(k, 1)
        keep, left = kept & own, np.zeros(len(kept), bool)
        is_own = own.tolist()
        for k in np.flatnonzero(~kept).tolist():
            flag = flags[centre[k]]
            if flag & 1:
                continue
            if is_own[k] and not flag:
                keep[k] = True
                mark(k, 1)
            else:
                left[k] = True
                mark(k, 2)
        return keep, left

    def work(table: pa.Table) -> Iterator[pa.Table]:
        group = tiles.numbers_of(table, 4)
        order = np.lexsort((table["rank"].to_numpy(), group))
        table, group = table.take(pa.array(order)), group[order]
        at = np.stack([table[c].to_numpy().astype(np.int64) for c in ("z", "y", "x")])
        low = np.stack([table[t].to_numpy().astype(np.int64) * side - shift for t in BLOCK[1:]])
        own = ((at >= low) & (at < low + side)).all(axis=0)
        kept = table["kept"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        judged = [judge(at[:, a:b], kept[a:b], own[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(group)))]
        keep, left = (np.concatenate(c) for c in zip(*judged))
        out = keep | (left & own)
        yield table.filter(pa.array(out)).select(["vol_id", "z", "y", "x", "rank"]).append_column("kept", pa.array(keep[out]))

    return work


def _around_tiles(points: DataFrame, side: int, reach: int, shift: int, ends: dict[str, tuple[int, int]]) -> DataFrame:
    """Each point under its own tile and under every tile within reach; none lies outside the ``ends`` of an axis."""
    for c, t in zip("zyx", BLOCK[1:]):
        first, last = ((end + shift) // side for end in ends[c])
        own = F.floor((F.col(c) + shift) / side).cast("int")
        inside = F.col(c) + shift - own * side
        reached = F.array(own, F.when((inside < reach) & (own > first), own - 1), F.when((inside >= side - reach) & (own < last), own + 1))
        points = points.withColumn(t, F.explode(F.array_compact(reached)))
    return points


def suppress(points: DataFrame, min_dist: float, order: list[Column], tile: int = TILE) -> DataFrame:
    """Greedy suppression: keep a point unless an earlier kept one is nearer than
    ``min_dist``.  ``points`` has integer ``z, y, x``; ``order`` is a total order.

    Every point is ranked; only the best of each voxel can be kept, which bounds what a
    tile holds.  A tile runs the greedy choice on its points, with those just outside it;
    a point that hangs on an undecided one outside stays open for the next round, which
    knows what the other tiles have decided.  The best open point is always decided, and
    no pairs of points are made.
    """
    if min_dist <= 0:
        return points
    ranked = store(number_in_order(points, order, "_rank"), "ranked")
    state = ranked.groupBy("vol_id", "z", "y", "x").agg(F.min("_rank").alias("rank")).withColumn("kept", F.lit(False))
    reach = int(-(-min_dist // 1)) - 1
    side = max(tile, reach + 1)
    limits = ranked.agg(*(of(c) for c in "zyx" for of in (F.min, F.max))).first()
    ends = {c: (int(limits[2 * k] or 0), int(limits[2 * k + 1] or 0)) for k, c in enumerate("zyx")}
    done, rounds = None, 0
    while True:
        # Every other round moves the tiles by half their side, so that no border stays one.
        shift = rounds % 2 * (side // 2)
        rounds += 1
        boxed = _around_tiles(state, side, reach, shift, ends)
        state = store(tiles.in_tables(boxed, _judge_tiles(side, reach, float(min_dist), shift), _POINT, _ROWS), "points")
        discard(done)
        done = state
        if state.filter("not kept").isEmpty():
            break
    kept = state.select("vol_id", F.col("rank").alias("_rank"))
    return ranked.join(kept, ["vol_id", "_rank"], "left_semi").drop("_rank")


def suppress_seeds(candidates: DataFrame, min_dist: float) -> DataFrame:
    """Kept seeds with ``new_label`` 1..n in order of priority.

    Without a minimum distance all are kept in component order.
    """
    if min_dist <= 0:
        return number_in_order(candidates, [F.col("component").asc()], "new_label")
    order = [F.col("internal_overlap").desc(), F.col("ring_contrast").desc(), F.col("area").asc(),
             F.col("component").asc()]
    return number_in_order(suppress(_at_centroid(candidates), min_dist, order), order, "new_label")


def suppress_markers(candidates: DataFrame, min_dist: float, max_markers: int = 0) -> DataFrame:
    """Kept markers with ``new_label``, at most ``max_markers`` per volume (0: all)."""
    order = [F.col("score").desc(), F.col("area").asc(), F.col("elongation").asc(), F.col("component").asc()]
    kept = number_in_order(suppress(_at_centroid(candidates), min_dist, order), order, "new_label")
    return kept.filter(F.col("new_label") <= max_markers) if max_markers > 0 else kept


def _at_centroid(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({c: F.col("c" + c) for c in "zyx"})


def seed_features(
    seeds: DataFrame, flat_lines: DataFrame, dark: DataFrame, catalog: DataFrame, rules: SeedRules,
    sampling: Sampling = Sampling(),
) -> DataFrame:
    """Seed components with ``reason``: the first failing rule, or ``candidate``.

    ``dark`` are runs with ``external``.  Each rule family only computes its
    features for components that passed the earlier, cheaper ones.
    """
    external, internal = dark.filter("external"), dark.filter("not external")
    shape = store(feat.centroids(feat.shapes(seeds), catalog).drop("depth", "height", "width"), "shapes")
    area_ok = F.col("area").between(rules.area_min, rules.area_max)
    sized = seeds.join(shape.filter(area_ok).select(*ID), ID, "left_semi")
    shares = feat.mask_share(sized, external, "external_overlap").join(
        feat.mask_share(sized, internal, "internal_overlap"), ID
    )
    staged = store(shape.join(shares, ID, "left"), "shares")
    inside = staged.filter(area_ok & (F.col("external_overlap") <= rules.max_external_overlap))
    thin = F.col("internal_overlap") < rules.min_internal_overlap
    near = feat.nearest_in_mask(inside.filter(thin), internal, catalog, rules.internal_search_radius)
    staged = store(staged.join(near, ID, "left"), "near")
    off_dark = thin & ~F.coalesce("near_internal", F.lit(True))
    sampled = staged.join(inside.select(*ID), ID, "left_semi").filter(~off_dark)
    gray = feat.contrasts(sampled, flat_lines, catalog, sampling).drop("score")
    cover = feat.ring_coverage(sampled, external, catalog, sampling.ring_inner, sampling.ring_outer)
    full = staged.join(gray, ID, "left").join(cover, ID, "left")
    rules_in_order = (
        ~area_ok,
        F.col("external_overlap") > rules.max_external_overlap,
        off_dark,
        F.col("center_mean") > rules.center_dark_max,
        F.col("ring_contrast") < rules.min_ring_contrast,
        F.col("ring_external_cov") > rules.max_ring_external_coverage,
    )
    return store(full.withColumn("reason", _first_failing(rules_in_order, REJECT_SEED)), "seeds")


def marker_features(
    components: DataFrame, flat_lines: DataFrame, catalog: DataFrame, rules: MarkerRules,
    sampling: Sampling = Sampling(),
) -> DataFrame:
    """Marker components with ``reason``: the first failing rule, or ``candidate``."""
    shape = feat.extents(feat.centroids(feat.shapes(components), catalog))
    shape = store(shape.drop("depth", "height", "width"), "shapes")
    bad_area = ~F.col("area").between(rules.area_min, rules.area_max)
    bad_shape = (
        (F.col("max_dim") > rules.max_dim)
        | (F.col("elongation") > rules.max_elongation)
        | (F.col("fill") < rules.min_fill)
    )
    gray = feat.contrasts(shape.filter(~bad_area & ~bad_shape), flat_lines, catalog, sampling)
    rules_in_order = (
        bad_area,
        bad_shape,
        F.col("center_mean") > rules.center_dark_max,
        F.col("ring_contrast") < rules.min_ring_contrast,
    )
    full = shape.join(gray, ID, "left")
    return store(full.withColumn("reason", _first_failing(rules_in_order, REJECT_MARKER)), "markers")


def _first_failing(rules, names) -> Column:
    reason = F.lit("candidate")
    for rule, name in reversed(list(zip(rules, names))):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    return reason


def tallies(judged: DataFrame, kept: DataFrame, names: tuple[str, ...], volumes: DataFrame | None = None) -> DataFrame:
    """``(vol_id, reason, n)`` with zeros, plus counts around the suppression.

    ``rejected_nms`` is the number of candidates that were not kept.  Volumes without
    any component only have rows if ``volumes`` (a catalog) lists them.
    """
    listed = (judged if volumes is None else volumes).select("vol_id").distinct().withColumn(
        "reason", F.explode(F.array(*[F.lit(n) for n in (*names, "candidate", "keep", "rejected_nms")]))
    )
    seen = judged.groupBy("vol_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    final = kept.groupBy("vol_id").agg(F.count(F.lit(1)).alias("n"))
    candidates = seen.filter("reason = 'candidate'").select("vol_id", F.col("n").alias("_all"))
    lost = candidates.join(final, "vol_id", "left").select(
        "vol_id", F.lit("rejected_nms").alias("reason"), (F.col("_all") - F.coalesce("n", F.lit(0))).alias("n")
    )
    counts = union_all(seen, final.select("vol_id", F.lit("keep").alias("reason"), "n"), lost)
    return listed.join(counts, ["vol_id", "reason"], "left").fillna(0, ["n"])


def _with_kept(judged: DataFrame, kept: DataFrame) -> DataFrame:
    """Rejected rows as they are, kept candidates numbered, the others left out."""
    rejected = judged.filter("reason <> 'candidate'").withColumn("new_label", F.lit(0).cast("long"))
    return rejected.unionByName(
        kept.select(*judged.columns, "new_label").withColumn("reason", F.lit("keep"))
    )


def seed_report(judged: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per seed component that passed the area rule.

    What the two metrics hold depends on the reason; columns that a rule had
    not reached yet are zero.
    """
    def reached(column: str, first: int, kind: str) -> Column:
        early = F.col("reason").isin(*REJECT_SEED[:first])
        return F.when(early, F.lit(0)).otherwise(F.col(column)).cast(kind)

    metric1 = (
        F.when(F.col("reason") == "external_background", F.lit(0.0))
        .when(F.col("reason") == "not_internal_dark", F.col("internal_dist"))
        .when(F.col("reason") == "ring_too_external", F.col("ring_external_cov"))
        .otherwise(F.col("center_mean"))
    )
    return _with_kept(judged, kept).filter("reason <> 'seed_area'").select(
        "vol_id",
        F.col("component").alias("seed_component"),
        "new_label",
        "reason",
        F.col("area").alias("seed_area"),
        "external_overlap",
        reached("internal_overlap", 2, "double").alias("internal_overlap"),
        *[reached("c" + c, 2, "int").alias(c) for c in "zyx"],
        metric1.cast("double").alias("metric1"),
        reached("ring_contrast", 3, "double").alias("metric2"),
    )


def marker_report(judged: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per marker component; columns a rule had not reached are zero."""
    def reached(column: str, first: int, kind: str) -> Column:
        early = F.col("reason").isin(*REJECT_MARKER[:first])
        return F.when(early, F.lit(0)).otherwise(F.col(column)).cast(kind).alias(column)

    return _with_kept(judged, kept).select(
        "vol_id",
        F.col("component").alias("component_id"),
        "new_label",
        "reason",
        "area",
        *[reached(c, 1, "int") for c in ("dx", "dy", "dz")],
        *[reached(c, 1, "double") for c in ("elongation", "fill")],
        *[reached(c, 2, "double") for c in ("center_mean", "ring_contrast")],
    )


def survivors(components: DataFrame, kept: DataFrame) -> DataFrame:
    """Runs of the kept components."""
    return components.join(kept.select(*ID), ID, "left_semi")


def centroid_points(kept: DataFrame) -> DataFrame:
    """``label`` at each centroid voxel; the last label wins on a shared voxel."""
    return kept.groupBy("vol_id", F.col("cz").alias("z"), F.col("cy").alias("y"), F.col("cx").alias("x")).agg(
        F.max("new_label").alias("label")
    )


def seed_points(kept: DataFrame) -> DataFrame:
    return centroid_points(kept).withColumn("label", F.lit(SEED_POINT_VALUE))
