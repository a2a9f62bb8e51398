"""N-gram Jaccard join: near copies by MinHash, Bayesian pruning and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, graph, texts
from voxmill.session import store

SHINGLE = 5
#: Similarity as a fraction: links have 5 * intersection >= 4 * union.
NUMERATOR, DENOMINATOR = 4, 5
#: MinHash values per text, and values per band: a pair at 0.8 shares no band with probability 5e-8.
VALUES, BAND = 128, 4
#: Pairs whose chance of reaching the threshold falls below this are dropped.
TOLERANCE = 1e-9
#: MinHash values compared before each decision.
STEP = 16
#: Texts of one candidate group, and about how many shingles of them, that one task compares with as many others.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 22
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096

_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 62, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, VALUES, dtype=np.uint64)


def least_matches(n: int) -> int:
    """Fewest matches among n values that leave the threshold possible.

    With a uniform prior on the similarity, m matches of n give Beta(m + 1, n - m + 1);
    its mass above t is the chance of at most m successes in n + 1 trials at t.
    """
    t, mass = NUMERATOR / DENOMINATOR, 0.0
    for m in range(n + 1):
        mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if mass >= TOLERANCE:
            return m
    return n


_LEAST = {n: least_matches(n) for n in range(STEP, VALUES + 1, STEP)}


def _shingled(column: pa.Array) -> Iterator[tuple[texts.Texts, texts.Words, np.ndarray, np.ndarray]]:
    for part in texts.slices(column):
        words = part.words(texts.SPACED)
        yield part, words, *texts.shingles(words, words.hashes(), SHINGLE)


def _node(words: texts.Words, i: int) -> int:
    """Number of a text: 63 bits of the digest of its words."""
    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
    return int.from_bytes(texts.digest(words.join(a, b))[:8], "little") >> 1


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, signed, sizes = [], [], []
        for part, words, grams, doc in _shingled(texts.column(batch, "text")):
            bounds = np.searchsorted(doc, np.arange(len(part) + 1))
            some = np.flatnonzero(bounds[1:] > bounds[:-1])
            table = np.zeros((VALUES, len(some)), dtype=np.uint32)
            for k in range(VALUES if len(some) else 0):
                table[k] = np.minimum.reduceat(grams * _A[k] + _B[k], bounds[some]) >> np.uint64(32)
            rows: list = [None] * len(part)
            for row, signature in zip(some.tolist(), np.ascontiguousarray(table.T), strict=True):
                rows[row] = signature.tobytes()
            nodes += [None if r is None else _node(words, i) for i, r in enumerate(rows)]
            signed += rows
            sizes.append(np.diff(bounds))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(np.concatenate([*sizes, np.zeros(0, dtype=np.int64)])), pa.array(signed, pa.binary())],
            ["doc_id", "h", "node", "size", "signature"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bucket) once per band."""
    for batch in batches:
        table = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, VALUES // BAND, BAND).astype(np.uint64)
        acc = np.broadcast_to(np.arange(1, VALUES // BAND + 1, dtype=np.uint64), table.shape[:2]).copy()
        for k in range(BAND):
            acc = texts.mix(acc * np.uint64(0x9E3779B97F4A7C15) + table[:, :, k])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), VALUES // BAND)), pa.array(acc.ravel().view(np.int64))], ["node", "bucket"])


def _shingle_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of texts that are what their node says."""
    for batch in batches:
        wanted, nodes, lists = batch.column(0).to_pylist(), [], []
        for part, words, grams, doc in _shingled(texts.column(batch, "text")):
            bounds = np.searchsorted(doc, np.arange(len(part) + 1))
            for i in range(len(part)):
                if wanted[part.first + i] == _node(words, i):
                    nodes.append(wanted[part.first + i])
                    lists.append(np.unique(grams[bounds[i]:bounds[i + 1]]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lists, pa.binary())], ["node", "shingles"])


def possible_pairs(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables that survive the Bayesian pruning."""
    n = len(left)
    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]  # a side may be empty
    for a in range(0, n, 128):
        i, j = np.indices((min(128, n - a), len(right))).reshape(2, -1)
        i += a
        if same:
            ahead = j > i
            i, j = i[ahead], j[ahead]
        met = np.zeros(len(i), dtype=np.int16)
        for k in range(0, VALUES, STEP):
            met += (left[i, k:k + STEP] == right[j, k:k + STEP]).sum(axis=1, dtype=np.int16)
            alive = met >= _LEAST[k + STEP]
            i, j, met = i[alive], j[alive], met[alive]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i), np.concatenate(found_j)


def shared_shingles(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection size of each pair of shingle sets."""
    if len(i) <= 2 * len(lists):
        return np.array([len(np.intersect1d(lists[a], lists[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    sizes = np.array([len(s) for s in lists])
    row = np.repeat(np.arange(len(lists)), sizes)
    _, column, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    often = counts[column] > 1
    row, column = row[often], (np.cumsum(counts > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(lists), len(lists)), dtype=np.float64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        part = np.zeros((len(lists), COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - c] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each component, by label passing and shortcuts."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _verify(table: pa.Table) -> pa.Table:
    """Links of the texts of one block pair: (node, links, root)."""
    nodes, first = np.unique(np.asarray(table["node"]), return_index=True)
    table = table.take(pa.array(first))
    signature = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint32).reshape(-1, VALUES)
    lists = [np.frombuffer(b, dtype=np.uint64) for b in table["shingles"].to_pylist()]
    copies, side = np.asarray(table["copies"]), np.asarray(table["side"])
    if (side == 0).all():
        i, j = possible_pairs(signature, signature, True)
    else:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        i, j = possible_pairs(signature[left], signature[right], False)
        i, j = left[i], right[j]
    size = np.array([len(s) for s in lists])
    met = shared_shingles(lists, i, j)
    near = DENOMINATOR * met >= NUMERATOR * (size[i] + size[j] - met)
    i, j = i[near], j[near]
    links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    return pa.table({"node": nodes, "links": links.astype(np.int64), "root": nodes[_roots(len(nodes), i, j)]})


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, class_size) of every document.

    Two documents are linked if the Jaccard similarity of their sets of 5-word
    shingles is at least 0.8.  Words are runs without ASCII white space, A-Z
    lower-cased; a text of 1 to 4 words is one shingle.  A class is a connected
    component of links, named by its least doc_id; ``n_links`` counts a document's
    links, copies included, and ``class_size`` the documents of its class.

    Documents of equal words are one text from the start.  Texts that share a band
    of MinHash values make up candidate groups (components of band buckets, found by
    joins and stars).  Inside a group, in blocks of bounded numbers of texts and shingles, every pair is
    compared value by value, dropped when its chance of reaching the threshold falls
    below ``TOLERANCE``, and verified exactly otherwise; tasks report links per text
    and a forest, never pairs.

    Null and empty texts have no shingles, no links and a class of their own, even
    next to each other; null ids are kept, and name a class only if no other id does.
    Repeated rows are copies of one another.  Texts are told apart by 63 bits of a
    digest of their words.
    """
    return _classes(docs).drop("h")


def _classes(docs: DataFrame) -> DataFrame:
    """As ``classes``, with the hash ``h`` of each text."""
    frames.modest_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = store(hashed.mapInArrow(_signatures, "doc_id long, h long, node long, size long, signature binary"), "signatures")
    known = (signed.where("node is not null").groupBy("node")
             .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature")))
    known = store(known, "texts")
    bands = known.select("node", "signature").mapInArrow(_bands, "node long, bucket long")
    hubs = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    edges = bands.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = graph.components(edges.distinct())
    members = store(groups.join(known, "node").select("node", "root", "least", "copies", "size", "signature"), "members")
    # Only groups of several blocks need their number; there is at most one for BLOCK texts or BLOCK_SHINGLES shingles.
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    large = store(members.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    wanted = frames.lookup(members.select(F.col("least").alias("doc_id"), "node"))
    lists = rows.alias("r").join(wanted.alias("w"), F.expr("r.doc_id <=> w.doc_id")).select("node", "text")
    lists = lists.mapInArrow(_shingle_lists, "node long, shingles binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sized = members.join(frames.lookup(large), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    work = sized.join(lists, "node").withColumn("block", block).withColumn("other", other).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "signature", "shingles",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"))
    met = store(work.groupBy("root", "i", "j").applyInArrow(_verify, "node long, links long, root long"), "links")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    forest = graph.components(met.where("links > 0").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = known.drop("size", "signature").join(links, "node", "left").join(forest, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = store(named, "named")
    whole = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(whole, "root").select("node", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "h", "node").join(named, "node", "left")
    return out.select("doc_id", "h", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the least doc_id.

    Other rows and all columns stay, and so do all documents without words.  Rows that
    repeat the kept doc_id and text are one row.  A row without an id goes if its class
    has an id; else one row of each of its texts stays.
    """
    found = store(_classes(docs), "classes")
    gone = found.where("class_id is not null and not doc_id <=> class_id").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    gone = frames.lookup(store(gone, "gone"))
    rows = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h")), "left_anti")
    again = found.where("class_size > 1 and doc_id <=> class_id").groupBy("doc_id", "h").count().where("count > 1")
    again = store(again.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "again")
    if again.limit(1).count():
        marked = kept.join(frames.lookup(again), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h")), "left")
        once = marked.where("_h is not null").dropDuplicates(["doc_id", "_key"])
        kept = marked.where("_h is null").unionByName(once)
    return kept.select(*docs.columns)
