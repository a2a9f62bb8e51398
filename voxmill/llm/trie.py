"""Prefix trie of conversations, rolled up in bands of depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.frames import lookup
from voxmill.session import by_block, store

#: A band has 2 to this power depths: a node is copied to at most so many ancestors.
BAND_BITS = 5
#: Conversations that begin with turns of another one share it by this modulus of their ids.
FAMILY = 100
#: Most turns that are taken over from the family's first conversation, plus one.
HEADS = 6
#: Turn numbers (and depths) that are put in order at once are 2 to this power.
STEP_BITS = 10
#: Ids of members are joined in pieces of ids that agree but for so many bits.
ID_BITS = 10
#: A parent of more children than this is looked up by broadcast, while such parents are few.
HOT = 1_000

_NO_TURN = -(1 << 60)


def _before(df: DataFrame, key: str, part: str, value: Column) -> Column:
    """Of the rows of one key: ``value`` over the parts before this one."""
    return value.over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per turn of the rebuilt conversations: ``conv_id``, ``depth`` from 1, ``a``, ``b``, ``chars``, and ``last``.

    ``a`` and ``b`` are two 64-bit hashes of role and text, ``chars`` the code points of the text;
    ``last`` marks a conversation's last turn.  A conversation without turns is one row of depth 0
    with ``last``.  Turns are put in order in steps of turn numbers, so that a long conversation
    is no single group.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"), F.char_length(text).cast("long").alias("chars"),
        F.md5(F.concat_ws("\n", role, text).cast("binary")).alias("tie")).where("conv_id is not null")
    turns = turns.withColumn("step", F.coalesce(F.shiftright("turn", STEP_BITS), F.lit(_NO_TURN)))
    steps = turns.groupBy("conv_id", "step").agg(F.count("*").alias("n"))
    steps = steps.withColumn("ahead", F.coalesce(_before(steps, "conv_id", "step", F.sum("n")), F.lit(0)))
    owns = steps.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    first = F.expr(f"conv_id - conv_id % {family}").alias("root_id")
    plans = owns.select("conv_id", "n_own", first, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int").alias("h"))
    roots = owns.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("root_id"), F.col("n_own").alias("n_root"))
    plans = plans.join(roots, "root_id", "left").select(
        "conv_id", "root_id", "h", F.least("h", F.coalesce("n_root", F.lit(0))).alias("got"), F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).alias("rest"))
    plans = store(plans.withColumn("size", F.col("got") + F.col("rest")), "plans")
    inside = Window.partitionBy("conv_id", "step").orderBy(F.col("turn").asc_nulls_first(), "tie", "a", "b")
    placed = turns.withColumn("at", F.row_number().over(inside)).join(
        steps.join(plans, "conv_id").select("conv_id", "step", "ahead", "h", "got", "size"), ["conv_id", "step"])
    placed = store(placed.select("conv_id", (F.col("at") + F.col("ahead")).alias("at"), "h", "got", "size", "a", "b", "chars"), "turns")
    own = placed.where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("got")).alias("depth"), "size", "a", "b", "chars")
    leading = placed.where((F.col("at") < heads) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("root_id"), F.col("at").alias("depth"), "a", "b", "chars")
    taken = plans.where("got > 0").join(leading, "root_id").where("depth <= got").select("conv_id", "depth", "size", "a", "b", "chars")
    zero = F.lit(0).cast("long")
    turnless = plans.where("size = 0").select("conv_id", zero.alias("depth"), "size", zero.alias("a"), zero.alias("b"), zero.alias("chars"))
    every = own.unionByName(taken).unionByName(turnless)
    return every.select("conv_id", F.col("depth").cast("long").alias("depth"), "a", "b", "chars", (F.col("depth") == F.col("size")).alias("last"))


_KEY = ["k1", "k2"]


def _with_path(rows: DataFrame, shift: int) -> DataFrame:
    """``rows`` at multiples of 2^shift with ``path``: keys from the band's first depth down to this one."""
    band = F.shiftright("depth", shift + BAND_BITS)
    step = F.shiftright("depth", max(STEP_BITS, shift + BAND_BITS))
    upto = Window.partitionBy("conv_id", "step", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(zero.alias("k1"), zero.alias("k2")))
    met = rows.withColumn("step", step).withColumn("band", band).withColumn("path", F.collect_list(F.struct(*_KEY)).over(upto))
    return met.withColumn("path", F.when(F.col("band") == 0, F.concat(root, "path")).otherwise(F.col("path"))).drop("step", "band")


def keyed(turns: DataFrame) -> DataFrame:
    """``turns`` of depth 1 on with the 128-bit keys (``k1``, ``k2``) of their prefix and (``p1``, ``p2``) of the one before.

    A prefix's key is the exclusive-or of hashes of depth and turn, so it adds up over the steps
    of a conversation in any order.  The empty prefix has the key (0, 0).
    """
    own = turns.where("depth > 0").withColumn("step", F.shiftright("depth", STEP_BITS))
    own = own.withColumn("h1", F.xxhash64("depth", "a", "b")).withColumn("h2", F.xxhash64("b", "depth", "a")).drop("a", "b")
    steps = own.groupBy("conv_id", "step").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    steps = steps.select("conv_id", "step", *(F.coalesce(_before(steps, "conv_id", "step", F.bit_xor(h)), F.lit(0)).alias(f"{h}_before") for h in ("h1", "h2")))
    upto = Window.partitionBy("conv_id", "step").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = own.select("*", *(F.bit_xor(h).over(upto).alias(f"{h}_upto") for h in ("h1", "h2"))).join(steps, ["conv_id", "step"])
    key = [F.col(f"{h}_upto").bitwiseXOR(F.col(f"{h}_before")) for h in ("h1", "h2")]
    return out.select("conv_id", "depth", "chars", "last", key[0].alias("k1"), key[1].alias("k2"),
                      key[0].bitwiseXOR(F.col("h1")).alias("p1"), key[1].bitwiseXOR(F.col("h2")).alias("p2"))


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_sums(nodes: DataFrame, rows: DataFrame, deepest: int, shift: int = 0) -> DataFrame:
    """``leaves`` and ``saved`` of each node (``k1``, ``k2``), summed over its subtree.

    ``nodes`` stand at multiples of 2^shift: key, ``depth``, ``path``, the key (``q1``, ``q2``) of
    the node one multiple above, and their own values; ``rows`` are all conversations' prefixes.
    Nodes are copied to their ancestors in the band.  The totals of nodes at the head of a band
    make a tree of their own, of a depth less by the band's height, that is summed alike; the
    completed totals are then copied to the band right above.
    """
    here = _summed(nodes.select(F.inline("path"), "leaves", "saved"))
    if deepest >> shift + BAND_BITS == 0:
        return here
    here = store(here, "band")
    heads = nodes.where((F.col("depth") > 0) & (F.col("depth") % (1 << shift + BAND_BITS) == 0)).select(*_KEY, "depth", "q1", "q2")
    above = nodes.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("path").alias("above"))
    links = store(heads.join(above, ["q1", "q2"]).select(*_KEY, "depth", "above"), "links")
    upper = rows.where(F.col("depth") % (1 << shift + BAND_BITS) == 0).select("conv_id", "depth", *_KEY)
    paths = _with_path(upper, shift + BAND_BITS).groupBy(*_KEY).agg(F.any_value("path").alias("path"))
    tops = links.join(here, _KEY).join(paths, _KEY).select(
        *_KEY, "depth", "path", F.col("above")[0]["k1"].alias("q1"), F.col("above")[0]["k2"].alias("q2"), "leaves", "saved")
    root = here.where("k1 = 0 and k2 = 0").select(
        *_KEY, F.lit(0).cast("long").alias("depth"), F.array(F.struct(*_KEY)).alias("path"), F.lit(0).cast("long").alias("q1"),
        F.lit(0).cast("long").alias("q2"), "leaves", "saved")
    whole = subtree_sums(store(tops.unionByName(root), "heads"), rows, deepest, shift + BAND_BITS)
    given = links.join(whole, _KEY).select(F.inline("above"), "leaves", "saved")
    return _summed(here.unionByName(given))


_ENDS = "k1 long, k2 long, ends_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each key, one after the other; the rows come sorted."""
    at, h = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) != at:
                if h is not None:
                    done.append((*at, h.hexdigest()))
                at, h = (k1, k2), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([h.hexdigest()])], ["k1", "k2", "ends_sha256"])


def ends_of(lasts: DataFrame) -> DataFrame:
    """Digest of the ascending, comma-joined ``conv_id`` of each key; a key's ids are joined in bounded pieces first."""
    pieces = lasts.groupBy(*_KEY, F.shiftright("conv_id", ID_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return by_block(pieces, *_KEY).sortWithinPartitions(*_KEY, "piece").select(*_KEY, "ids").mapInArrow(_digests, _ENDS)


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations.

    ``conversations`` has ``conv_id`` (an integer), ``turn``, ``role`` and ``text``; other columns
    go.  Each conversation c begins with the first crc32(c) mod ``heads`` turns of c - c mod
    ``family`` and goes on with its own turns behind as many.  Each distinct sequence of first d
    turns is a node of depth d; the root has no turn.  Returns per node ``conv_id`` (least member),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    Turns are ordered by number, null first, ties by the MD5 sum of role, line break and text.  A null role or text is empty;
    rows without conv_id belong to no conversation and go.  Repeated rows are turns of their own.
    Ids below zero have the remainder's sign.  A table without conversations gives no rows, not
    even a root.  Nodes are told apart by 128 bits of hash.
    """
    turns = store(rebuilt(conversations, family, heads), "rebuilt")
    rows = store(_with_path(keyed(turns), 0), "prefixes")
    zero = F.lit(0).cast("long")
    found = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.max("chars").alias("chars"), F.any_value("path").alias("path"))
    everyone = turns.where("last").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("deepest")).first()
    spark = conversations.sparkSession
    root = spark.range(1 if everyone["n_convs"] else 0).select(
        zero.alias("k1"), zero.alias("k2"), F.lit(everyone["n_convs"]).cast("long").alias("n_convs"), F.lit(everyone["conv_id"]).cast("long").alias("conv_id"),
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("chars"), F.array(F.struct(zero.alias("k1"), zero.alias("k2"))).alias("path"))
    nodes = store(found.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = store(nodes.drop("path").join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "parents")
    valued = nodes.select(*_KEY, "depth", "path", F.col("p1").alias("q1"), F.col("p2").alias("q2")).join(parents.select(
        *_KEY, (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), _KEY)
    sums = subtree_sums(store(valued, "valued"), rows, everyone["deepest"] or 0)
    ends = ends_of(turns.where("last and depth = 0").select("conv_id", zero.alias("k1"), zero.alias("k2")).unionByName(
        rows.where("last").select("conv_id", *_KEY)))
    # The parent of many nodes is one row: those are looked up apart.
    named = parents.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = lookup(store(named.where(F.col("n_children") > HOT).drop("n_children").withColumnRenamed("parent_conv_id", "hot_conv_id"), "hot"))
    cold = named.where(F.col("n_children") <= HOT).drop("n_children")
    below = parents.where("depth > 0").join(hot, ["p1", "p2"], "left")
    kin = below.where("hot_conv_id is not null").withColumnRenamed("hot_conv_id", "parent_conv_id").unionByName(
        below.where("hot_conv_id is null").drop("hot_conv_id").join(cold, ["p1", "p2"])).unionByName(
        parents.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = kin.join(sums, _KEY).join(ends, _KEY, "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
