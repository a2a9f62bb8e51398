"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: Most copies of a source or document.
MOST = 2
#: Blocks that one source and size class is split into.
BLOCKS = 64
SEED = 11

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """Target of each source: ``source``, ``source_size``, ``n_docs``, ``target``, ``rate``.

    ``sizes`` has one row per source.  Targets follow the weights, but none is above
    ``MOST`` times its source's size; the excess is shared by weight among the others.
    That is min(cap, level * weight) at the level where the targets make up the share:
    with the sources in order of cap / weight, the capped ones come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (place + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", MOST * F.col("source_size").cast("double"))
        .withColumn("total", share * F.sum(F.col("source_size")).over(everything).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "n_docs", "target", "rate")
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``docs`` has ``doc_id``, ``text`` and ``source``.  Every document of a source has
    the same expected number of copies, target / source_size.  Along an order of the
    source's documents (by size, then by hash) the expected copies are summed, one
    offset in [0, 1) drawn from the seed and the source is added, and a document is
    emitted once per integer that its own step crosses: floor or ceil of the rate.
    Sorting by size spreads the copies over all sizes, which keeps the words taken
    close to the target.

    The sum over a source is a sum over its blocks (size class and hash, counted
    before any shuffle of rows), plus a rank inside the block: no task holds a source.
    A source, null included, is a group of its own; null texts have size 0.  Repeated
    rows are separate documents; they tie, and which of them gets a copy is open, the
    number of copies is not.  A table without words gets no copies.  Earlier columns
    of the new names are replaced.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    taken_names = {n.lower() for n in new}
    kept = [c for c in docs.columns if c.lower() not in taken_names]
    names = {c.lower(): c for c in docs.columns}
    held = {c: f"_kept{k}" for k, c in enumerate(kept)}  # apart from the names used here; unused ones are pruned
    source, text, doc_id = (F.col(held[names[c]]) for c in ("source", "text", "doc_id"))
    rows = docs.select(*(F.col(f"`{c}`").alias(held[c]) for c in kept))
    rows = rows.withColumn("size", n_words(text))
    # SQL's md5 agrees everywhere, so that reruns and other engines draw alike.
    rows = rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")))
    # Eight classes per doubling of the size: the leading bit and the three behind it, in whole numbers.
    bit = F.length(F.bin("size")) - 1
    rows = rows.withColumn("class", (8 * bit + F.call_function("shiftright", F.col("size") * 8, bit)).cast("int"))
    rows = rows.withColumn("block", F.conv(F.substring("draw", 1, 4), 16, 10).cast("int") % BLOCKS)
    # A key without nulls: the join below keeps the partitions of the ranking.
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")))
    counted = rows.groupBy("src", "class", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    # Within a class the blocks are laid one behind the other.
    totals = counted.groupBy("src").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    goals = targets(totals.withColumn("source", F.when(F.col("src") != "", F.expr("substring(src, 2)"))).drop("src"))
    before = Window.partitionBy("src").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("offset"), F.coalesce("source", F.lit("\x01null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    goals = goals.withColumn("offset", offset)
    goals = goals.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    plan = starts.join(goals, "src").select("src", "class", "block", "ahead", "source_size", "target", "rate", "offset")
    inside = Window.partitionBy("src", "class", "block").orderBy("size", "draw", doc_id.asc_nulls_first())
    ranked = rows.withColumn("place", F.row_number().over(inside))
    met = ranked.join(plan, ["src", "class", "block"])
    rank = F.col("ahead") + F.col("place")
    upto = lambda r: F.floor(r * F.col("rate") + F.col("offset"))
    met = met.withColumn("copies", (upto(rank) - upto(rank - 1)).cast("long"))
    return met.select(*(F.col(held[c]).alias(c) for c in kept), "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document once per copy, with its ``copy`` number from 1."""
    mixed = mix(docs, seed)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
