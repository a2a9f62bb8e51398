"""Quality classifier by importance resampling of hashed n-gram models.

A generative model of the target (documents labelled good) and one of the raw
text (all documents) give each document a log importance weight, the sum over
its unigrams and bigrams of log p_target - log p_raw.  Gumbel top-k draws k
documents without replacement in proportion to the weights; what is not drawn
is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, texts
from voxmill.session import store

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 13
#: Most labelled rows that the target model and the cut are fitted on.
LABELLED_ROWS = 20_000
#: What losing a share of the good documents weighs against letting the same share of the bad ones pass.
LOSS = 10.0
#: Counts per bucket that the raw model lends to the target model.
PRIOR = 20.0
SEED = 7


def features(part: texts.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each unigram and bigram (words and runs of signs).

    Bigrams of one word twice share the last bucket, whatever the word is.
    """
    words = part.words(texts.SIGNS)
    h = words.hashes()
    two, at = words.grams(h, 2)
    one, pairs = (h % np.uint64(BUCKETS - 1)).astype(np.int64), (two % np.uint64(BUCKETS - 1)).astype(np.int64)
    if len(at):
        pairs[h[at] == h[at + 1]] = BUCKETS - 1
    return np.concatenate([one, pairs]), np.concatenate([words.doc, words.doc[at]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        target = np.asarray(batch.column(1).fill_null(False))
        for part in texts.slices(texts.column(batch, "text")):
            bucket, doc = features(part)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[target[part.first + doc]], minlength=BUCKETS)
    some = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array(total[0, some]), pa.array(total[1, some])], ["bucket", "raw", "target"])


def weigher(table: np.ndarray):
    """Log importance weight of each text of a string array."""
    def weights(column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for part in texts.slices(column):
            bucket, doc = features(part)
            out[part.first:part.first + len(part)] = np.bincount(doc, table[bucket], minlength=len(part))
        return out
    return weights


def _best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut between two scores that catches most bad ones, where a share of lost good ones weighs ``LOSS`` as much."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / max(1, g.sum())
    caught = np.concatenate([[0], np.cumsum(~g)]) / max(1, (~g).sum())
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    possible = np.concatenate([[True], s[1:] > s[:-1], [True]])
    value = np.where(possible, caught - LOSS * lost, -2 * LOSS)
    return float(edges[int(np.argmax(value))])


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with ``log_weight``, ``sample_key`` (double) and ``kept`` (boolean).

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``
    (1 good, 0 bad).  The target model is fitted on good labelled documents, at most
    ``LABELLED_ROWS`` labelled rows (those of the smallest hashes; a fixed bound);
    a quarter of them is held back to find the cut that tells good from bad.  k is the
    number of documents, of all, whose weight passes the cut; the k largest keys
    (weight plus Gumbel noise drawn from the seed and the text) are kept.

    Null and empty texts have weight 0.  Rows with equal keys, such as repeated
    rows, are kept or rejected together.  With no good labelled row, or no bad one,
    every document is kept.  Earlier columns of the new names are replaced.
    """
    frames.modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = frames.fresh(docs, "log_weight", "sample_key", "kept")
    names = {c.lower(): c for c in docs.columns}
    known = (labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].alias("good"))
             .where("label_id is not null and good in (0, 1)").groupBy("label_id").agg(F.min("good").alias("good"))
             .orderBy(F.xxhash64("label_id", F.lit(seed)), "label_id").limit(LABELLED_ROWS))
    known = spark.createDataFrame(known.collect(), known.schema)  # at most LABELLED_ROWS
    fold = F.pmod(F.xxhash64("label_id", F.lit(seed + 1)), F.lit(4)) == 0
    marked = docs.select(docs[names["doc_id"]].cast("long").alias("label_id"), docs[names["text"]].alias("text")) \
        .join(F.broadcast(known.withColumn("fold", fold)), "label_id", "left")
    target = F.coalesce((F.col("good") == 1) & ~F.col("fold"), F.lit(False))
    counts = (marked.select("text", target.alias("target")).mapInArrow(_counts, "bucket int, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    model = np.zeros((2, BUCKETS))
    for r in counts.collect():  # at most BUCKETS rows
        model[:, r["bucket"]] = r["raw"], r["target"]
    raw = (model[0] + 1.0) / (model[0] + 1.0).sum()
    table = np.log((model[1] + PRIOR * BUCKETS * raw) / (model[1].sum() + PRIOR * BUCKETS)) - np.log(raw)
    if not model[1].any():
        table[:] = 0.0
    shared = spark.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = weigher(shared.value)
        for batch in batches:
            column = texts.column(batch, names["text"])
            w = weights(column)
            key = w + gumbel(column, seed)
            kept = pa.nulls(len(column), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w), pa.array(key), kept], [*batch.schema.names, *new])

    new = ["log_weight", "sample_key", "kept"]
    schema = frames.with_columns(docs, log_weight=T.DoubleType(), sample_key=T.DoubleType(), kept=T.BooleanType())
    narrow = docs.select(F.col(names["doc_id"]).cast("long").alias("doc_id"), F.col(names["text"]).alias("text"))
    slim = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *schema.fields[-3:]])

    def slim_weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = weigher(shared.value)
        for batch in batches:
            column = texts.column(batch, "text")
            w = weights(column)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.nulls(len(column), pa.string()), pa.array(w), pa.array(w + gumbel(column, seed)),
                 pa.nulls(len(column), pa.bool_())], ["doc_id", "text", *new])

    scored = store(narrow.mapInArrow(slim_weigh, slim).select("doc_id", "log_weight", "sample_key"), "weights")
    held = (scored.join(F.broadcast(known.where(fold)), F.col("doc_id") == F.col("label_id"))
            .groupBy("label_id").agg(F.first("log_weight").alias("w"), F.first("good").alias("good")).collect())
    good = np.array([r["good"] == 1 for r in held], dtype=bool)
    if not model[1].any() or not good.any() or good.all():
        cut = None
    else:
        cut = kth = _best_cut(np.array([r["w"] for r in held]), good)
        k = scored.where(F.col("log_weight") > cut).count()
        kth = frames.kth_largest(scored, "sample_key", k)
        cut = float("inf") if kth is None else kth
    out = docs.mapInArrow(weigh, schema)
    return out.withColumn("kept", F.lit(True) if cut is None else F.col("sample_key") >= F.lit(cut))


def gumbel(column: pa.Array, seed: int) -> np.ndarray:
    """Gumbel noise from the seed and each text: reruns and repeated rows agree."""
    out = np.zeros(len(column), dtype=np.uint64)
    salt = seed.to_bytes(8, "little", signed=True)
    for part in texts.slices(column):
        for i in range(len(part)):
            out[part.first + i] = int.from_bytes(texts.digest(salt, part.raw(i))[:8], "little")
    u = ((out >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))
