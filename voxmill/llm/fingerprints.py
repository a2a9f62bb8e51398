"""Document fingerprints: every shingle hash below a fixed fraction of the hash range.

Such sketches merge by union, and because the threshold is the same for all
texts, the containment of a short text in a very long one is estimated as well
as that of equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, texts

SHINGLE = 5
#: One shingle in this many is retained.
SCALE = 8
_LIMIT = np.uint64(((1 << 64) - 1) // SCALE)
#: Sketches are printed with this many of their 64 bits.
_BITS = 48
#: Most ranges of doc_id that neighbours are looked up in; each is sorted on its own.
MOST_RANGES = 1000


def sketches(column: pa.Array) -> list[np.ndarray]:
    """Sorted retained hashes of each text.

    The least hash is always retained, so that only a text without words has an
    empty sketch; the least of a union is the least of the parts, so union merges.
    """
    out: list[np.ndarray] = []
    for part in texts.slices(column):
        words = part.words(texts.SPACED)
        grams, doc = texts.shingles(words, words.hashes(), SHINGLE)
        low = np.flatnonzero(grams <= _LIMIT)
        bounds, all_bounds = np.searchsorted(doc[low], np.arange(len(part) + 1)), np.searchsorted(doc, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = grams[low[bounds[i]:bounds[i + 1]]]
            if not len(own) and all_bounds[i] < all_bounds[i + 1]:
                own = grams[all_bounds[i]:all_bounds[i + 1]].min(keepdims=True)
            out.append(np.unique(own))
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    both = np.union1d(a, b)
    low = both[both <= _LIMIT]
    return low if len(low) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return 1.0 if not len(a) else len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; 1 if neither has shingles."""
    if not len(a) and not len(b):
        return 1.0
    met = len(np.intersect1d(a, b, assume_unique=True))
    return met / (len(a) + len(b) - met)


def printed(sketch: np.ndarray) -> str:
    return (sketch >> np.uint64(64 - _BITS)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with the ``sketch`` (array of longs) and ``fingerprint`` (hex) of each ``text``.

    Null and empty texts have an empty sketch, equal texts equal ones.  One narrow
    pass.  Earlier columns of the new names are replaced.
    """
    frames.modest_batches(docs.sparkSession)
    docs = frames.fresh(docs, "sketch", "fingerprint")
    name = {c.lower(): c for c in docs.columns}["text"]
    schema = frames.with_columns(docs, sketch=T.ArrayType(T.LongType()), fingerprint=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(texts.column(batch, name))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([printed(s) for s in found], pa.string())],
                [*batch.schema.names, "sketch", "fingerprint"])

    return docs.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the start of the next text."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def _in_ranges(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text), sorted by range of doc_id; each range ends with its successor.

    The successor, a guest, is the first row of the next range (of the first range for
    the last).  Only the bounds and first ids of the ranges pass through the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.select("doc_id")
    parts = min(MOST_RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts)))
    part = F.lit(0)
    if cuts:
        at = F.array(*(F.lit(int(c)) for c in cuts))
        part = F.coalesce(F.aggregate(at, F.lit(0), lambda n, c: n + F.when(c <= F.col("doc_id"), 1).otherwise(0)), F.lit(0))
    firsts = (ids.groupBy(part.alias("part")).agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nameless"))
              .orderBy("part").collect())
    guests = [(None if r["nameless"] else r["least"], firsts[k - 1]["part"]) for k, r in enumerate(firsts)]  # before the first comes the last
    host = docs.sparkSession.createDataFrame(guests, "first_id long, host int")
    own = rows.select(part.cast("int").alias("part"), F.lit(0).alias("guest"), "doc_id", "text")
    visiting = rows.join(F.broadcast(host), F.col("doc_id").eqNullSafe(F.col("first_id"))).select(F.col("host").alias("part"), F.lit(1).alias("guest"), "doc_id", "text")
    return own.unionByName(visiting).repartition(parts, "part").sortWithinPartitions("part", "guest", "doc_id", "text")


_PAIRS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # the last row seen: it waits for its successor
    for batch in batches:
        own = sketches(texts.column(batch, "text"))
        rows = held + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                               ((t or "") for t in batch.column(3).to_pylist()), own, strict=True))
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[1]]
        held = rows[-1:]
        changed = [edited(a[3], b[3]) for a, b in pairs]
        other = sketches(pa.array(changed, pa.large_string()))
        yield pa.RecordBatch.from_pylist([
            {"doc_id": a[2], "n_chars": len(a[3]), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": printed(a[4]),
             "edited_fingerprint": printed(o), "near_edited": likeness(a[4], o), "near_next": likeness(a[4], b[4])}
            for (a, b), e, o in zip(pairs, changed, other, strict=True)], schema=_ARROW)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def against_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.  The edited text has its
    last quarter replaced by as much of the start of the next document's text.  Next is
    by ascending doc_id (null first, ties by text); after the last comes the first, and
    a single document follows itself.  Null texts count as empty; repeated rows follow
    one another.  Texts are moved once, to their range of doc_id.
    """
    frames.modest_batches(docs.sparkSession)
    return _in_ranges(docs).mapInArrow(_pairs, _PAIRS)
