"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.session import discard, store

#: More rounds than any graph of a cluster's size can need.
MOST_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a > b), again as distinct edges a > b.

    Large: every node links its larger neighbours to the least node around it.
    Small: every node links its smaller neighbours, and itself, to the least of them.
    """
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = around.join(least, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is its component's least node.

    Large and small stars alternate until nothing changes; the number of edges never
    grows, a hub's edges meet its least neighbour in a join that Spark may split, and
    each round is stored and takes the place of the one before.  Loops count as nodes of their own.
    """
    start = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    lone = start.where("a = b").select(F.col("a").alias("node"))
    pairs, before, state = start.where("a <> b"), None, None
    for _ in range(MOST_ROUNDS):
        pairs = store(_stars(_stars(pairs, True), False), "stars")
        discard(before)
        before = pairs
        seen = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("connected components made no progress")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = pairs.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    known = nodes.unionByName(tops)
    return known.unionByName(lone.join(known, "node", "left_anti").withColumn("root", F.col("node")))
