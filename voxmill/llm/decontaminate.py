"""Benchmark decontamination by a broadcast hash set of benchmark windows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, texts
from voxmill.session import store

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Bytes of benchmark text that one broadcast may index; more is done in several passes.
INDEX_BYTES = 16 << 20

NEW = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
_SPANS = T.ArrayType(T.ArrayType(T.LongType()))


class WindowIndex:
    """Windows of some benchmark items: hashes by window length, words and items by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.found: dict[int, dict[int, dict[bytes, set[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, text in items:
            column = pa.array([text or ""], pa.large_string())
            for part in texts.slices(column):
                words = part.words(texts.PLAIN)
                n = min(WINDOW, len(words))
                if n:
                    grams, at = words.grams(words.hashes(), n)
                    for g, i in zip(grams.tolist(), at.tolist(), strict=True):
                        self.found[n][g][words.join(i, i + n)].add(item)
        self.found = {n: {g: dict(w) for g, w in by.items()} for n, by in self.found.items()}
        self.hashes = {n: np.array(sorted(by), dtype=np.uint64) for n, by in self.found.items()}

    def hits(self, words: texts.Words) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, word behind the last, items) of each verified window."""
        if not self.hashes:
            return
        h = words.hashes()
        for n, known in self.hashes.items():
            grams, at = words.grams(h, n)
            if not len(grams):
                continue
            near = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            for k in np.flatnonzero(known[near] == grams).tolist():
                i = int(at[k])
                items = self.found[n][int(grams[k])].get(words.join(i, i + n))
                if items is not None:
                    yield i, i + n, items

    def report(self, column: pa.Array) -> Iterator[tuple[int, int, list[list[int]], list[int]]]:
        """Of each text: words, hit words, hit runs as [first, end) word positions, items."""
        for part in texts.slices(column):
            words = part.words(texts.PLAIN)
            edge, items = np.zeros(len(words) + 1, dtype=np.int64), defaultdict(set)
            for i, j, found in self.hits(words):
                edge[i] += 1
                edge[j] -= 1
                items[int(words.doc[i])] |= found
            hit = np.cumsum(edge[:-1]) > 0
            for d in range(len(part)):
                a, b = int(words.bounds[d]), int(words.bounds[d + 1])
                if d not in items:
                    yield b - a, 0, [], []
                    continue
                own = np.concatenate([[False], hit[a:b], [False]])
                turns = np.flatnonzero(own[1:] != own[:-1])
                yield b - a, int(hit[a:b].sum()), turns.reshape(-1, 2).tolist(), sorted(items[d] - {None}, key=str)


def _shards(benchmark: DataFrame | None) -> tuple[int, Iterator[list[tuple[int | None, str]]]]:
    """Number of parts of at most about ``INDEX_BYTES`` of text each, and the parts, one in the driver at a time."""
    if benchmark is None:
        return 1, iter([[]])
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // INDEX_BYTES) + 1
    own = (items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts))
    return parts, ([(r["item_id"], r["text"]) for r in part.collect()] for part in own)  # bounded by INDEX_BYTES


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with what of each text occurs in the benchmark.

    New columns: ``n_words``, ``n_hit``, ``n_items`` (long), ``items`` (item ids
    sorted as strings), ``spans`` (hit runs as [first, end) word positions) and
    ``contaminated``.  Words are runs of ASCII letters (lower-cased), digits and
    characters beyond ASCII; a window is 13 words, or a whole shorter item.
    Matching hashes are verified on the words.

    Null and empty texts have no words; items without text or words give no window.
    Windows of an item without id hit words but name no item; repeated items count
    once per id.  Item ids are whole numbers, others an error.  Repeated rows get equal
    results.  Earlier columns of the new names are replaced.  A benchmark beyond
    ``INDEX_BYTES`` is searched in several passes, one broadcast each.
    """
    frames.modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = frames.fresh(docs, *NEW)
    name = {c.lower(): c for c in docs.columns}["text"]
    schema = frames.with_columns(docs, n_words=T.LongType(), n_hit=T.LongType(), items=T.ArrayType(T.LongType()), spans=_SPANS)
    parts, shards = _shards(benchmark)

    def judge(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, hit, spans, items = zip(*shared.value.report(texts.column(batch, name)), strict=True) if len(batch) else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                     pa.array(spans, pa.list_(pa.list_(pa.int64())))], [*batch.schema.names, "n_words", "n_hit", "items", "spans"])
        return run

    if parts == 1:
        out = docs.mapInArrow(judge(spark.sparkContext.broadcast(WindowIndex(next(shards)))), schema)
    else:
        out = _merged(docs, name, shards, judge, schema)
    return out.select(
        *docs.columns, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _merged(docs: DataFrame, name: str, shards: Iterator, judge, schema: T.StructType) -> DataFrame:
    """One pass per part of the benchmark; a text's hits are united by the text's digest."""
    spark = docs.sparkSession
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.sha2(F.coalesce(F.col(name), F.lit("")), 256).alias("_key"))
    slim = keyed.select("_key", F.col(f"_row.{name}").alias(name)).dropDuplicates(["_key"])
    slim_schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField(name, T.StringType()), *schema.fields[-4:]])
    found = None
    for shard in shards:
        shared = spark.sparkContext.broadcast(WindowIndex(shard))
        part = store(slim.mapInArrow(judge(shared), slim_schema).select("_key", "n_words", "items", "spans"), "hits")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    covered = (found.select("_key", F.explode("spans").alias("s")).select("_key", F.explode(F.expr("sequence(s[0], s[1] - 1)")).alias("w"))
               .distinct().groupBy("_key").agg(F.sort_array(F.collect_list("w")).alias("w")))
    runs = F.expr("""aggregate(w, cast(array() as array<array<bigint>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1)[1] = x
             then concat(slice(acc, 1, size(acc) - 1), array(array(element_at(acc, -1)[0], x + 1)))
             else concat(acc, array(array(x, x + 1))) end)""")
    items = found.groupBy("_key").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    items = items.withColumn("items", F.expr("transform(array_sort(transform(items, i -> cast(i as string))), i -> cast(i as bigint))"))
    found = items.join(covered.select("_key", F.size("w").cast("long").alias("n_hit"), runs.alias("spans")), "_key", "left")
    empty = F.expr("cast(array() as array<array<bigint>>)")
    return keyed.join(found, "_key").select(
        "_row.*", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "items", F.coalesce("spans", empty).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated documents; columns and other rows stay as they are."""
    found = find_hits(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text")), benchmark)
    return found.where(~F.col("contaminated")).select("_row.*")
