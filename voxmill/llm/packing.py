"""Order-preserving packing of token streams into windows by dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, texts
from voxmill.llm.tokens import Encoder

#: Tokens of a sequence; a shorter one is padded to this, unless its length is a power of two.
LIMIT = 4096
#: The id behind each document.
END_ID = 2
#: Cost, in tokens of padding, of a cut at a sentence's end and inside a sentence; at a document's end it is free.
SENTENCE_CUT, INNER_CUT = 8, 48
#: Each sequence costs this much, so that of equal padding the longer sequences win.
SEQUENCE = 16
#: Inside a sentence a cut is possible behind every so many of its tokens.
STRIDE = 32
#: Tokens that are laid out at once; the last windows are laid out again with what follows.
HORIZON = 1 << 19
#: Texts are packed in blocks of this many bytes by order of doc_id, or of this share of all bytes.
BLOCK_BYTES, MOST_BLOCKS = 16 << 20, 1 << 15
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 8 << 20


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE, fine: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending from 0, and the cost of a cut at each.

    Each of the last ``fine`` positions is one of them: what is left at the end of a block is
    then cut into lengths that need no padding, if that is cheaper.
    """
    marks = np.union1d(np.append(doc_ends, 0), sentence_ends)
    gaps = np.diff(marks)
    wide = np.flatnonzero(gaps > stride)
    more = (gaps[wide] - 1) // stride
    inner = np.repeat(marks[wide], more) + stride * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    at = np.union1d(marks, np.append(inner, np.arange(max(0, marks[-1] - fine), marks[-1])))
    cost = np.full(len(at), INNER_CUT, dtype=np.int64)
    cost[np.searchsorted(at, sentence_ends)] = SENTENCE_CUT
    cost[np.searchsorted(at, doc_ends)] = 0
    cost[0] = 0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, limit: int = LIMIT, last: bool = True) -> list[int]:
    """Positions of the cuts of least total cost, from 0 on.

    A window over (i, j] costs its padding, ``limit`` less its length (nothing at a power of
    two), and the cost of the cut at j.  The least waste(i) + at(i) of the starts within reach
    stands at the head of a queue that is kept ascending; starts at a distance of a power of
    two are looked up.  With ``last`` the final position has to be reached; else the cheapest
    of the positions less than ``limit`` before it ends the layout.
    """
    n = len(at)
    ends, starts = [], []
    for k in range(limit.bit_length()):
        if 1 << k <= limit:
            i = np.searchsorted(at, at - (1 << k))
            hit = np.flatnonzero(at[i] == at - (1 << k))
            ends.append(hit)
            starts.append(i[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    order = np.argsort(ends, kind="stable")
    ends, starts = [*ends[order].tolist(), n], starts[order].tolist()
    pos, extra = at.tolist(), (cost + SEQUENCE).tolist()
    waste, came, key = [0] * n, [0] * n, [0] * n
    queue, e = deque([0]), 0
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - limit:
            queue.popleft()
        i = queue[0]
        best = key[i] + limit - p
        while ends[e] == j:
            s = starts[e]
            e += 1
            if waste[s] < best:
                best, i = waste[s], s
        waste[j], came[j] = best + extra[j], i
        k = key[j] = waste[j] + p
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not last:
        j = min((k for k in range(n - 1, 0, -1) if pos[k] > pos[-1] - limit), key=waste.__getitem__, default=j)
    cuts = [pos[j]]
    while j:
        j = came[j]
        cuts.append(pos[j])
    return cuts[::-1]


class Packer:
    """Lays out the documents of one block, given one by one; pieces come out in order."""

    def __init__(self, block: int, limit: int = LIMIT, horizon: int = HORIZON):
        self.first_sequence, self.limit, self.horizon = block << 32, limit, horizon
        self.docs: list[list] = []  # [doc_id, ids, sentence ends, ids already out]
        self.open = 0
        self.sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray, sentences: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, sentences, 0])
        self.open += len(ids)
        if self.open >= self.horizon + self.limit:
            yield from self._lay_out(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.docs:
            yield from self._lay_out(last=True)

    def _lay_out(self, last: bool) -> Iterator[tuple]:
        left = [len(ids) - out for _, ids, _, out in self.docs]
        doc_ends = np.cumsum(left)
        begins = doc_ends - left
        sentences = [b + s[(s > out) & (s < len(ids) - 1)] - out for b, (_, ids, s, out) in zip(begins.tolist(), self.docs, strict=True)]
        marks = candidates(doc_ends, np.concatenate(sentences), min(STRIDE, self.limit), self.limit if last else 0)
        cuts = best_cuts(*marks, self.limit, last)
        d = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sequence = self.first_sequence + self.sequences
            self.sequences += 1
            at = a
            while at < b:
                doc = self.docs[d]
                n = min(b - at, len(doc[1]) - doc[3])
                yield doc[0], doc[3], n, doc[1][doc[3]:doc[3] + n].tobytes(), len(doc[1]), sequence, at - a
                doc[3] += n
                at += n
                if doc[3] == len(doc[1]):
                    d += 1
        self.docs = self.docs[d:]
        self.open -= cuts[-1]


class Blocks:
    """Numbers blocks of documents in the order of doc_id, null first, without holding them.

    ``first[k]`` is the least doc_id of range k; a range of a single id that is larger than a
    block is dealt to ``parts[k]`` blocks by a checksum of the text.
    """

    def __init__(self, nulls: int, ranges: list[tuple[int, int]]):
        self.first = np.array([f for f, _ in ranges], dtype=np.int64)
        self.parts = np.array([nulls, *(p for _, p in ranges)], dtype=np.int64)
        self.base = np.cumsum(self.parts) - self.parts

    def of(self, doc_id: np.ndarray, null: np.ndarray, checksum: np.ndarray) -> np.ndarray:
        k = np.where(null, 0, np.maximum(np.searchsorted(self.first, doc_id, side="right"), 1 if len(self.first) else 0))
        return self.base[k] + checksum % self.parts[k]


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES, most: int = MOST_BLOCKS) -> Blocks:
    """Blocks of about equal bytes of text by order of doc_id, the same for any partitions.

    Bytes are added up by leading bits of the id; only ids under bits that are heavier than a
    block are looked at again with more bits.  The driver sees at most 2^17 sums in the first
    round and 16 for each heavy one (at most ``most`` of them) in the others.
    """
    sizes = docs.select(F.col("doc_id").alias("id"), (F.octet_length("text") + 8).cast("long").alias("b")).withColumn("b", F.coalesce("b", F.lit(8).cast("long")))
    low, high, total, nulls = sizes.agg(F.min("id"), F.max("id"), F.sum("b"), F.sum(F.when(F.col("id").isNull(), F.col("b")))).first()
    want = max(block_bytes, (total or 0) // most)
    parts = lambda n: max(1, -(-(n or 0) // want))
    if low is None:
        return Blocks(parts(nulls), [])
    shift = max(0, (high - low).bit_length() - 16)
    sums: list[tuple[int, int, int]] = []  # (least id, shift, bytes)
    todo = sizes.where("id is not null")
    while True:
        rows = todo.groupBy(F.shiftright("id", shift).alias("k")).agg(F.sum("b").alias("b")).collect()
        heavy = [r["k"] for r in rows if r["b"] > want and shift]
        again = set(heavy)
        sums += [(r["k"] << shift, shift, r["b"]) for r in rows if r["k"] not in again]
        if not heavy:
            break
        above = docs.sparkSession.createDataFrame([(k,) for k in heavy], "k long")  # at most `most` rows
        todo = todo.join(F.broadcast(above), F.shiftright("id", shift) == F.col("k"), "left_semi")
        shift = max(0, shift - 4)
    ranges, filled = [], want
    for least, _, b in sorted(sums):
        if filled + b > want:
            ranges.append((least, parts(b)))
            filled = 0
        filled += b
    return Blocks(parts(nulls), ranges)


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """One encoder a worker process, with what it remembers."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


_STREAM = "block long, doc_id long, ids binary, sentences binary"
_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType())])
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                           ("sequence_id", pa.int64()), ("offset", pa.int64())])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[DataFrame, np.dtype]:
    """``block``, ``doc_id``, ``ids`` and ``sentences`` of each document, and the type of the ids.

    ``ids`` are little-endian unsigned numbers of 16 bits, or 32 where the vocabulary needs it, with
    ``end_id`` behind the text's own; ``sentences`` are positions of 32 bits where sentences end.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = blocks_of(rows)
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    width = np.dtype("<u2") if max(Encoder(vocabulary.value).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            texts_of, ids_of = texts.column(batch, "text"), batch.column(0)
            for part in texts.slices(texts_of, ENCODE_BYTES):
                ids, bounds, stops = encoder.encode(part)
                own = ids_of.slice(part.first, len(part))
                sums = np.fromiter((hash_of(part.raw(i)) for i in range(len(part))), np.int64, len(part)) if blocks.parts.max() > 1 else np.zeros(len(part), np.int64)
                block = blocks.of(own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), sums)
                narrow, cut = ids.astype(width), np.searchsorted(stops, bounds, side="right")
                end = np.array([end_id], dtype=width).tobytes()
                streams, sentences = [], []
                for i in range(len(part)):
                    a, b = bounds[i], bounds[i + 1]
                    streams.append(narrow[a:b].tobytes() + end)
                    sentences.append((stops[cut[i]:cut[i + 1]] - a).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(block), own, pa.array(streams, pa.binary()), pa.array(sentences, pa.binary())],
                                                 ["block", "doc_id", "ids", "sentences"])

    return rows.mapInArrow(run, _STREAM), width


def hash_of(raw: bytes) -> int:
    return int.from_bytes(texts.digest(raw)[:4], "little")


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents in sequences of at most ``limit`` tokens.

    ``docs`` has ``doc_id`` (an integer) and ``text``; ``tokenizer`` is the path of a vocabulary
    file, read by the driver.  Returns one row per piece: ``doc_id``, ``start`` (ids of its
    document before it), ``length``, ``ids`` (little-endian unsigned 32-bit numbers),
    ``doc_tokens`` (with ``end_id``), ``sequence_id`` and ``offset`` in that sequence.  Other
    columns go.

    The documents stay in the order of doc_id (null first, ties by their ids); so do the sequences
    in the order of ``sequence_id``.  Windows end at documents' or sentences' ends where they can;
    the cuts minimise padding plus the cost of cuts inside documents.  A sentence longer than
    ``STRIDE`` can be cut inside.  Blocks of documents are laid out apart from one another, their
    last windows included, and a task holds about ``HORIZON`` tokens or one document.

    A null text counts as empty; an empty text is one piece of ``end_id``.  Repeated rows are
    separate documents.  An empty table gives no rows.  The result does not depend on partitions.
    """
    frames.modest_batches(docs.sparkSession)
    stream, width = tokenized(docs, tokenizer, end_id)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size = None, [], 0
        at = None

        def full(more: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            for piece in more:
                held.append(piece)
                size += piece[2]
                if size >= HORIZON or len(held) >= 8 * frames.BATCH_ROWS:
                    yield rows()

        def rows() -> pa.RecordBatch:
            nonlocal held, size
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)
            held, size = [], 0
            return out

        for batch in batches:
            for block, doc_id, ids, sentences in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    if packer is not None:
                        yield from full(packer.finish())
                    packer, at = Packer(block, limit), block
                numbers = np.frombuffer(ids, dtype=width).astype("<u4")
                yield from full(packer.add(doc_id, numbers, np.frombuffer(sentences, dtype="<u4").astype(np.int64)))
        if packer is not None:
            yield from full(packer.finish())
        if held:
            yield rows()

    return stream.repartition(spread, "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(run, _PIECES)
