"""Substring dedup: suffix automata of reference shards, documents streamed through them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, texts
from voxmill.llm.automaton import SuffixAutomaton
from voxmill.session import store

WINDOW = 50
#: Words of the grams whose least hash stands for a window.
GRAM = 10
#: Anchors that are broadcast at most; beyond it they are joined.
ANCHORS = 2_000_000
#: Texts of one anchor from which its passages are split into single windows.
HOT = 400
#: Passages of one shard, about.
SHARD = 800
#: Window starts to remove that are broadcast at most; beyond it they are joined.
STARTS = 500_000
_LAST = (1 << 63) - 1


def _least_before(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the position of the least of g[i:i + width]; of equals, the first."""
    at, reach = np.arange(len(g)), 1
    while reach * 2 <= width:
        a, b = at[:-reach], at[reach:]
        at, reach = np.where(g[b] < g[a], b, a), reach * 2
    rest = width - reach
    if rest:
        a, b = at[:-rest], at[rest:]
        at = np.where(g[b] < g[a], b, a)
    return at


def passages(words: texts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor, document, first window, number of windows), and the word hashes.

    The anchor of a window is the least hash among its grams.  Equal windows have equal
    anchors, and each window is in one passage.
    """
    h = words.hashes()
    none = np.zeros(0, dtype=np.int64)
    if len(h) < WINDOW:
        return none.astype(np.uint64), none, none, none, h
    grams = np.zeros(len(h) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + h[k:len(h) - GRAM + 1 + k]
    grams = texts.mix(grams)
    at = _least_before(grams, WINDOW - GRAM + 1)
    inside = np.flatnonzero(words.doc[:len(at)] == words.doc[WINDOW - 1:])
    if not len(inside):
        return none.astype(np.uint64), none, none, none, h
    at = at[inside]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)])
    first = np.flatnonzero(new)
    return grams[at[first]], words.doc[inside[first]], inside[first], np.diff(np.append(first, len(at))), h


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, h): anchors of each text, each once."""
    for batch in batches:
        for part in texts.slices(texts.column(batch, "text")):
            m, doc, *_ = passages(part.words(texts.SPACED, lower=False))
            order = np.lexsort((m, doc))
            m, doc = m[order], doc[order]
            first = np.ones(len(m), dtype=bool)
            first[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
            m, doc = m[first], doc[first]
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), batch.column(0).take(pa.array(part.first + doc))], ["m", "h"])


_PASSAGES = "h long, owner long, start int, shard long, content long, words string"
_PASSAGE_NAMES = ["h", "owner", "start", "shard", "content", "words"]


def _cut(lists, shards: int):
    """Passages of the wanted anchors; those of hot anchors as single windows.

    ``lists(batch)`` gives sorted wanted anchors and their numbers of parts for row i.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = lists(batch)
            h, owner = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in texts.slices(texts.column(batch, "text")):
                words = part.words(texts.SPACED, lower=False)
                m, doc, first, windows, hashes = passages(words)
                rows: list[list] = [[] for _ in _PASSAGE_NAMES]
                for k in range(len(m)):
                    i = part.first + int(doc[k])
                    known, parts = wanted(i)
                    spot = int(np.searchsorted(known, m[k])) if len(known) else 0
                    if spot >= len(known) or known[spot] != m[k]:
                        continue
                    a, n, split = int(first[k]), int(windows[k]), int(parts[spot])
                    for start, count in ([(a, n)] if split == 1 else [(a + w, 1) for w in range(n)]):
                        end = start + count + WINDOW - 1
                        content = texts.digest(hashes[start:end].tobytes())
                        place = int.from_bytes(content[8:], "little") % split
                        shard = int(texts.mix(m[k:k + 1] + np.uint64(place))[0] % np.uint64(shards))
                        cells = (h[i], owner[i], start - int(words.bounds[doc[k]]), shard, int.from_bytes(content[:8], "little", signed=True), words.join(start, end))
                        for column, cell in zip(rows, cells, strict=True):
                            column.append(cell)
                arrays = [pa.array(c, t) for c, t in zip(rows[:5], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(rows[5], pa.binary()).cast(pa.string())], _PASSAGE_NAMES)

    return run


def _match(table: pa.Table) -> pa.Table:
    """Least owner of each window of each passage of a shard: (content, owners)."""
    order = np.argsort(np.asarray(table["owner"]), kind="stable")
    content, owner = np.asarray(table["content"])[order].tolist(), np.asarray(table["owner"])[order].tolist()
    strings = table["words"].to_pylist()
    number: dict[str, int] = {}
    words = [[number.setdefault(w, len(number)) for w in strings[i].split(" ")] for i in order.tolist()]
    automaton = SuffixAutomaton()
    for w, o in zip(words, owner, strict=True):
        automaton.add(w, o)
    found = [list(automaton.least_owners(w, WINDOW)) for w in words]
    return pa.table({"content": pa.array(content, pa.int64()), "owners": pa.array(found, pa.list_(pa.int64()))})


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeats(docs: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(h, owner, starts): by the hash of a text, its least doc_id and the window starts that an earlier document has."""
    frames.modest_batches(docs.sparkSession)
    slim = docs.select(_text_hash(F.col("text")).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("owner"), F.col("text").cast("string").alias("text"))
    marked = slim.select("h", "text").mapInArrow(_anchors, "m long, h long")
    n = F.count("*")
    shared = (marked.groupBy("m").agg(F.min("h").alias("low"), F.max("h").alias("high"), n.alias("n")).where("low <> high")
              .select("m", "n", F.when(F.col("n") > HOT, F.ceil(F.col("n") * 8 / HOT)).otherwise(1).cast("int").alias("parts")))
    shared = store(shared, "anchors")
    known, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = int(total) // SHARD + 1
    least = store(slim.groupBy("h").agg(F.min("owner").alias("owner"), F.count("*").alias("copies")), "owners")
    if known <= anchors:
        table = shared.select("m", "parts").toArrow()  # at most ``anchors`` rows
        m = np.asarray(table["m"]).astype(np.int64).view(np.uint64)
        order = np.argsort(m)
        held = docs.sparkSession.sparkContext.broadcast((m[order], np.asarray(table["parts"])[order]))

        def lists(batch):
            return lambda i: held.value

        rows = slim
    else:
        def lists(batch):
            column = batch.column(3)

            def of(i):
                pairs = sorted((p["m"] % (1 << 64), p["parts"]) for p in column[i].as_py())
                return np.array([p[0] for p in pairs], dtype=np.uint64), [p[1] for p in pairs]
            last = [-1, None]

            def kept(i):
                if last[0] != i:
                    last[:] = i, of(i)
                return last[1]
            return kept

        wanted = marked.join(shared.select("m", "parts"), "m").groupBy("h").agg(F.collect_set(F.struct("m", "parts")).alias("anchors"))
        wanted = wanted.join(least.select("h", "owner"), "h")
        rows = slim.join(wanted, ["h", "owner"]).select("h", "owner", "text", "anchors")
    cut = store(rows.mapInArrow(_cut(lists, shards), _PASSAGES), "passages")
    contents = cut.groupBy("shard", "content").agg(F.min("owner").alias("owner"), F.first("words").alias("words"))
    matched = contents.groupBy("shard").applyInArrow(_match, "content long, owners array<long>")
    met = cut.select("h", "owner", "start", "content").join(least.select("h", F.col("owner").alias("own")), "h").where("owner = own").drop("own") \
        .join(matched, "content")
    starts = F.expr("filter(transform(owners, (x, i) -> if(x < owner, start + i, -1)), s -> s >= 0)")
    starts = met.select("h", starts.alias("s")).where("size(s) > 0").groupBy("h").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts"))
    return store(least.join(starts, "h", "left").where("copies > 1 or starts is not null").select("h", "owner", "starts"), "repeats")


def without_repeats(docs: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``.

    A window is ``WINDOW`` consecutive words (runs without ASCII white space, unchanged)
    of one document.  Every word of a window that also occurs in a document of smaller
    doc_id is removed, judged on the texts as they came; ``kept_text`` has the other
    words, joined by one space.

    Texts whose copies have a smaller id go whole (if they have a window).  Among
    different texts, only windows whose anchor occurs in two of them are looked at.
    Their passages meet by anchor in reference shards of bounded size; each shard's
    suffix automaton is built in the task that owns it, because the references grow with
    the corpus and could not be broadcast, and the shard's passages are streamed through
    it.  Hot anchors are split into windows, and equal passages are one before they meet.

    Null and empty texts have no words.  Rows of equal doc_id remove nothing from one
    another; a null id counts as greater than all.  Earlier columns of the new names are
    replaced.  Equal 64-bit text hashes are taken for equal texts.
    """
    frames.modest_batches(docs.sparkSession)
    docs = frames.fresh(docs, "n_words", "n_removed", "kept_text")
    found = repeats(docs, anchors)
    if found.agg(F.coalesce(F.sum(F.size(F.coalesce("starts", F.array())) + 1), F.lit(0))).first()[0] <= STARTS:
        found = F.broadcast(found)
    rows = docs.withColumn("_h", _text_hash(F.col("text"))).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    joined = rows.join(found.select(F.col("h").alias("_h"), F.col("owner").alias("_owner"), F.col("starts").alias("_starts")), "_h", "left")
    joined = joined.select(*docs.columns, F.coalesce(F.col("_owner") < F.col("_id"), F.lit(False)).alias("_copy"), "_starts")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    name = {c.lower(): c for c in docs.columns}["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, starts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
            n_words, n_removed, kept = [], [], []
            for part in texts.slices(texts.column(batch, name)):
                words = part.words(texts.SPACED, lower=False)
                for i in range(len(part)):
                    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                    gone = np.zeros(b - a + 1, dtype=np.int64)
                    if copy[part.first + i] and b - a >= WINDOW:
                        gone[0] = 1
                    elif starts[part.first + i].is_valid:
                        at = np.array(starts[part.first + i].as_py(), dtype=np.int64)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + WINDOW, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    turns = np.flatnonzero(np.diff(np.concatenate([[1], gone.astype(np.int8), [1]])))
                    kept.append(b" ".join(words.join(a + int(s), a + int(e)) for s, e in turns.reshape(-1, 2)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                schema.fieldNames())

    return joined.mapInArrow(run, schema)
