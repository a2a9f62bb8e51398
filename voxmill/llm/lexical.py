"""Ranked lexical search: few queries against all texts, by one automaton scan of the texts.

There is no index of the documents.  The terms of all queries, each between two guards,
form an Aho-Corasick automaton that is broadcast; a scan of a text whose signs are turned
into guards counts each term's occurrences.  Two passes follow over these counts, one for
the totals and one for the scores.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, texts
from voxmill.session import discard, store

#: Documents returned for each query.
TOP = 10
#: Bytes of query text that one automaton may hold; more queries are done in several passes.
INDEX_BYTES = 1 << 20
#: Cells of one table of scores, documents by queries.
CELLS = 1 << 20
#: The best of the tasks are ranked in this many groups before they are ranked together.
GROUPS = 64

_GUARD = 0x20
#: A-Z in lower case, signs as guards: what is left are terms.
_SCANNED = bytes(texts._LOWER[b] if texts.PLAIN[b] else _GUARD for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SCANNED).split(b" ")


class Terms:
    """Terms of some queries in order, and of each term the queries that hold it."""

    def __init__(self, queries: dict[int | None, set[bytes]]):
        self.ids = sorted(queries, key=lambda q: (q is not None, q))
        self.terms = sorted(set().union(*queries.values())) if queries else []
        number = {t: k for k, t in enumerate(self.terms)}
        held = [sorted(number[t] for t in queries[q]) for q in self.ids]
        pairs = np.array([(t, q) for q, ts in enumerate(held) for t in ts], dtype=np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.queries = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        """Guarded terms; bytes stand as characters, so that a term is matched as it is written."""
        out = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            out.add_word(f" {t.decode('latin-1')} ", k)
        if self.terms:
            out.make_automaton()
        return out


def _parts(benchmark: DataFrame, index_bytes: int) -> Iterator[Terms]:
    """Queries in parts of about ``index_bytes`` of text, one at a time; rows of one id stay together."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(total // index_bytes) + 1
    for p in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p)
        queries: dict = defaultdict(set)
        for r in own.collect():  # bounded by index_bytes
            queries[r["item_id"]] |= {t for t in terms_of(r["text"]) if t}
        yield Terms(queries)


def counts(part: texts.Texts, automaton: ahocorasick.Automaton, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; (text, term, occurrences) of the automaton's terms."""
    kept = texts.PLAIN[part.data]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    firsts = part.offsets[:-1][np.diff(part.offsets) > 0]
    begins[firsts] = kept[firsts]
    n = np.diff(np.append(0, np.cumsum(begins))[part.offsets])
    none = np.zeros(0, dtype=np.int64)
    if not n_terms or not n.any():
        return n, none, none, none
    # A guard before each text and one behind the last; each character is one byte.
    guarded = np.insert(part.data, part.offsets, _GUARD).tobytes().translate(_SCANNED).decode("latin-1")
    found = np.fromiter(chain.from_iterable(automaton.iter(guarded)), dtype=np.int64).reshape(-1, 2)
    if not len(found):
        return n, none, none, none
    # A match ends at its closing guard, which is at most that before the next text.
    text = np.searchsorted(part.offsets[1:] + np.arange(1, len(part) + 1), found[:, 0], side="left")
    pairs, tf = np.unique(text * n_terms + found[:, 1], return_counts=True)
    return n, pairs // n_terms, pairs % n_terms, tf


_COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"


def _counted(docs: DataFrame, terms: Terms) -> DataFrame:
    """``doc_id``, ``n`` (all terms of the text), ``terms`` and ``tfs`` of the queries' terms in it."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            for part in texts.slices(texts.column(batch, "text")):
                n, text, term, tf = counts(part, automaton, len(shared.value.terms))
                bounds = pa.array(np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, len(part)), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int32)))],
                    ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _COUNTED)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def scores(terms: Terms, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Table of scores, documents by queries, from (document, term, occurrences) and each document's m.

    A term's part goes to the queries that hold it, in whole numbers.
    """
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    times = terms.bounds[term + 1] - terms.bounds[term]
    upto = np.cumsum(times)
    cell = np.repeat(doc * len(terms.ids), times)
    cell += terms.queries[np.repeat(terms.bounds[term] - (upto - times), times) + np.arange(int(upto[-1]) if len(upto) else 0)]
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], np.repeat(value, times)[order]
    out = np.zeros(len(m) * len(terms.ids), dtype=np.int64)
    if len(cell):
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        out[cell[first]] = np.add.reduceat(value, first)
    return out.reshape(len(m), -1)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L of each document, also where the product passes 64 bits."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * k * n_docs // n_terms for k in n.tolist()], dtype=np.int64)
    return 10 + 90 * n * n_docs // max(n_terms, 1)


_RANKED = "item_id long, doc_id long, score long, part int"


def _best(counted: DataFrame, terms: Terms, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best documents of each query in each task."""
    shared = counted.sparkSession.sparkContext.broadcast((terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in terms.ids]  # heaps of (score, -doc_id); no id comes last
        rows = max(1, CELLS // max(1, len(terms.ids)))
        floor = np.zeros(len(terms.ids), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                n = batch.column(1).to_numpy()
                flat, tf = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
                doc = np.repeat(np.arange(len(n)), batch.column(2).value_lengths().to_numpy())
                table = scores(terms, weight, doc, flat, tf, lengths(n, n_docs, n_terms))
                ids = batch.column(0).to_pylist()
                for d, q in zip(*(x.tolist() for x in np.nonzero((table > 0) & (table >= floor))), strict=True):
                    entry = (int(table[d, q]), -math.inf if ids[d] is None else -ids[d])
                    heap = best[q]
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        floor[q] = heap[0][0]
        found = [(q, None if d == -math.inf else -d, s) for q, heap in zip(terms.ids, best, strict=True) for s, d in heap]
        item, doc_id, score = zip(*found, strict=True) if found else ((), (), ())
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64()),
                                          pa.array([part] * len(found), pa.int32())], ["item_id", "doc_id", "score", "part"])

    return counted.mapInArrow(run, _RANKED)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text`` (integer ids; others
    are an error of the cast); other columns go.  Terms are runs of ASCII letters, digits and
    characters beyond ASCII, A-Z lower-cased, of the whole text.  The score adds, over the item's
    distinct terms, weight(df) * saturation(tf, length), in whole numbers.

    Scores of 0 are left out, so an item without terms, or whose terms no document has, gives no
    row; equal scores are ranked by doc_id, no id last.  Null and empty texts have no terms and do
    not count as documents.  Repeated documents are ranked each; items that share an id, also the
    null id, are one item with the terms of all its rows.  Empty tables give no rows.

    All texts are scanned once for each ``index_bytes`` of item text.  Counts are stored between
    the totals and the scores; a task keeps ``top`` documents an item.
    """
    frames.modest_batches(docs.sparkSession)
    out = None
    for terms in _parts(items, index_bytes):
        counted = store(_counted(docs, terms), "counted")
        total = counted.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
        df = np.zeros(len(terms.terms), dtype=np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the terms of the part
            df[r["t"]] = r["count"]
        best = store(_best(counted, terms, weights(df, n_docs), n_docs, n_terms, top), "best")
        discard(counted)
        out = best if out is None else out.unionByName(best)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = out.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("place") <= top)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
