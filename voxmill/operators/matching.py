"""Optimal one-to-one matching of true and predicted instances.

Maximises the total IoU, and of equal totals the sum of a hash of the chosen pairs, so
that there is one answer.  Pairs that do not overlap add nothing, so the problem
falls apart along the overlap graph.  Touching neighbours usually tie a whole
volume into one component, so certain pairs are taken first: a pair that beats
the best alternatives of both its members together is in every optimum (any
pair above two thirds does).  What remains are knots, each solved by shortest
augmenting paths on whole numbers.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import by_block, discard, store, union_all
from .components import merge

#: Most pairs of one knot, which is a task's block (some 500 bytes a pair).  A larger
#: one is refused: uncertain overlaps of one volume that are tied together this far
#: mean that the labels do not fit at all.
KNOT_PAIRS = 500_000
_MARGIN = 1e-12
_PAIR = "vol_id int, gt_id long, pred_id long, iou double"


def optimal_matching(pairs: DataFrame, knot_pairs: int = KNOT_PAIRS) -> DataFrame:
    """Chosen ``(vol_id, gt_id, pred_id, iou)`` out of overlapping pairs."""
    pairs = pairs.select(
        "vol_id", F.col("gt_id").cast("long"), F.col("pred_id").cast("long"), F.col("iou").cast("double")
    )
    left = store(pairs, "overlaps")
    chosen = []
    while not left.isEmpty():
        sure = store(_certain(left), "matched")
        if sure.isEmpty():
            break
        chosen.append(sure)
        before = left
        for end in ("gt_id", "pred_id"):
            left = left.join(sure.select("vol_id", end), ["vol_id", end], "left_anti")
        left = store(left.select("vol_id", "gt_id", "pred_id", "iou"), "overlaps")
        discard(before)
    if not left.isEmpty():
        chosen.append(_knots(left, knot_pairs))
    return union_all(*chosen) if chosen else left


def _certain(pairs: DataFrame) -> DataFrame:
    """Pairs that outweigh the best other pairs of both members together."""
    marked = pairs
    for end, other in (("gt_id", "pred_id"), ("pred_id", "gt_id")):
        top = F.max(F.struct(F.col("iou"), -F.col(other)))
        best = pairs.groupBy("vol_id", end).agg((-top["col2"]).alias("_" + end))
        marked = marked.join(best, ["vol_id", end])
    marked = marked.withColumn("_g", F.col("_gt_id") == F.col("pred_id")).withColumn(
        "_p", F.col("_pred_id") == F.col("gt_id")
    )
    sure = marked.filter("_g and _p")
    for end, flag in (("gt_id", "_g"), ("pred_id", "_p")):
        second = marked.filter(~F.col(flag)).groupBy("vol_id", end).agg(F.max("iou").alias("_2" + end))
        sure = sure.join(second, ["vol_id", end], "left")
    rivals = F.coalesce("_2gt_id", F.lit(0.0)) + F.coalesce("_2pred_id", F.lit(0.0))
    return sure.filter(F.col("iou") > rivals + _MARGIN).select("vol_id", "gt_id", "pred_id", "iou")


def _knots(pairs: DataFrame, knot_pairs: int) -> DataFrame:
    """Solve each component of the remaining overlap graph."""
    g, p = F.col("gt_id") * 2, F.col("pred_id") * 2 + 1
    roots = merge(pairs.select("vol_id", F.least(g, p).alias("a"), F.greatest(g, p).alias("b")))
    tied = pairs.withColumn("node", g).join(roots, ["vol_id", "node"]).drop("node")
    tied = store(tied.withColumnRenamed("root", "knot"), "knots")
    largest = tied.groupBy("vol_id", "knot").count().agg(F.max("count")).first()[0]
    if largest > knot_pairs:
        raise ValueError(f"a knot of {largest} overlapping pairs; at most {knot_pairs} are supported")
    return store(by_block(tied, "vol_id", "knot").groupBy("vol_id", "knot").applyInPandas(_solve, _PAIR), "matched")


def pair_weight(gt_id: int, pred_id: int, iou: float) -> int:
    """IoU in steps of 2^-60, then the tie rule: 40 bits of the pair's md5, with room for 2^20 pairs."""
    tie = int(hashlib.md5(f"{gt_id}:{pred_id}".encode()).hexdigest()[:10], 16)
    return (math.floor(iou * 2.0**60) << 60) + tie + 1


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best assignment of one knot."""
    pdf = pdf.reset_index(drop=True)
    gts, gi = np.unique(pdf["gt_id"], return_inverse=True)
    preds, pi = np.unique(pdf["pred_id"], return_inverse=True)
    links: list[list[tuple[int, int]]] = [[] for _ in gts]
    for row, col, g, p, iou in zip(gi.tolist(), pi.tolist(), pdf["gt_id"].tolist(), pdf["pred_id"].tolist(), pdf["iou"].tolist()):
        links[row].append((col, pair_weight(g, p, iou)))
    taken = assign(links, len(preds))
    return pdf.loc[taken[gi] == pi, ["vol_id", "gt_id", "pred_id", "iou"]]


def assign(links: list[list[tuple[int, int]]], cols: int) -> np.ndarray:
    """Column of each row (-1: none) with the largest total weight, exactly.

    ``links`` has (column, positive whole weight) per row.  Shortest augmenting paths
    with row and column prices over the links alone; every row owns an extra column of
    weight 0, so staying alone is always possible.
    """
    price: dict[int, int] = {}
    owner: dict[int, int] = {}
    held = [-1] * len(links)
    costs = [[*((c, -w) for c, w in own), (cols + r, 0)] for r, own in enumerate(links)]
    row_price = [min(w for _, w in own) for own in costs]
    for start in range(len(links)):
        reach: dict[int, int] = {}
        via: dict[int, int] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        row, so_far = start, 0
        while True:
            base = so_far - row_price[row]
            for col, cost in costs[row]:
                step = base + cost - price.get(col, 0)
                if col not in done and step < reach.get(col, step + 1):
                    reach[col], via[col] = step, row
                    heapq.heappush(heap, (step, col))
            so_far, nearest = heapq.heappop(heap)
            while nearest in done:
                so_far, nearest = heapq.heappop(heap)
            done[nearest] = so_far
            if nearest not in owner:
                break
            row = owner[nearest]
        row_price[start] += so_far
        for col, at in done.items():
            price[col] = price.get(col, 0) - (so_far - at)
            if col in owner:
                row_price[owner[col]] += so_far - at
        col = nearest
        while True:
            row = via[col]
            owner[col], held[row], col = row, col, held[row]
            if row == start:
                break
    return np.array([c if c < cols else -1 for c in held], dtype=np.int64)
