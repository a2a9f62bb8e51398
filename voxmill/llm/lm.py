"""LM scoring: a log-bilinear neural model, trained in NumPy by noise-contrastive estimation.

The model predicts the next of the frequent words, the end of a text, or "another
word" from the two tokens before; another word is then drawn by its smoothed count.
The frequent words are those that occur ``LEAST`` times, up to ``MODEL_WORDS`` of them;
counts cover all words, so they grow with the corpus.  A word is predicted as its class, then as itself in the class, so that normalising
takes about the root of their number.  So every text has a normalised probability,
whatever its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm import frames, texts
from voxmill.session import by_block, discard, store

#: Training count from which the neural model tells a word apart, most of the top words
#: that it knows in any case, and the bound on its words (its size, so that of each
#: broadcast, is bounded too); the end of a text and another word come on top.
LEAST = 100
HEAD = 254
MODEL_WORDS = 1 << 14
WIDTH = 16
ORDER = 2
#: Noise classes of a batch, and noise words of a token in its class.
NOISE, NOISE_INSIDE = 32, 4
BATCH = 1024
#: Parts of the training texts; after each, the tasks' models are averaged.
ROUNDS = 4
#: A learner with fewer batches in a round (a corpus of under a million tokens) repeats them up to this number, at most ``EPOCHS`` times.
STEPS, EPOCHS = 200, 10
#: Training tokens of a learner: texts are dealt to learners by hash, so that neither partitions nor cores matter.
LEARNER_TOKENS = 8_000_000
#: Rows of the model in one row of the averaging.
BLOCK = 64
RATE = 0.05
#: Most words whose counts are broadcast beside the model's own; counts of rarer words are joined.
KNOWN = 1 << 18
#: Different words a task holds before it passes counts on.
HELD = 1 << 20
SMOOTH = 0.1
#: Documents whose crc32 has remainder 0 by this are held out.
FOLDS = 10

END_HASH = np.uint64(0x5F3C2A9E7B1D4E60)


class Tokens:
    """Token hashes of some texts: the words of each, then one end."""

    def __init__(self, part: texts.Texts):
        words = part.words(texts.SPACED)
        ends = words.bounds[1:] + np.arange(len(part))
        self.hashes = np.empty(len(words) + len(part), dtype=np.uint64)
        is_end = np.zeros(len(self.hashes), dtype=bool)
        is_end[ends] = True
        self.hashes[ends] = END_HASH
        self.hashes[~is_end] = words.hashes()
        self.counts = np.diff(words.bounds) + 1
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(part)), self.counts)


def _folded(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text); a null id counts as an empty one."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(text.cast("binary")) % FOLDS == 0).alias("held_out"),
                       F.col("text").cast("string").alias("text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c) of the tokens of a task."""
    def out(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for part in texts.slices(texts.column(batch, "text")):
            held.append(np.unique(Tokens(part).hashes, return_counts=True))
            if sum(len(h) for h, _ in held) > HELD:
                held = [_added(held)]
                if len(held[0][0]) > HELD // 2:
                    yield out(*held[0])
                    held = []
    if held:
        yield out(*_added(held))


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    return h, np.bincount(where, np.concatenate([c for _, c in held]), len(h)).astype(np.int64)


def count_words(folded: DataFrame) -> DataFrame:
    """(h, c): count of every token of the training documents, by the hash of the word."""
    counted = folded.where("not held_out").select("text").mapInArrow(_counts, "h long, c long")
    return store(counted.groupBy("h").agg(F.sum("c").alias("c")), "counts")


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of at most ``most`` words, none rarer than those left out."""
    level = F.floor(F.log2("c") * 16).cast("int")
    rows = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["level"])
    least, n = None, 0
    for r in rows:
        n += r["n"]
        if n > most:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    table = counts.where(F.col("c") >= least).select("h", "c").toArrow()  # at most ``most`` rows
    h, c = np.asarray(table["h"]).astype(np.int64).view(np.uint64), np.asarray(table["c"]).astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


class Vocabulary:
    """Ids of tokens in the model: words of the head by falling count, the end, another word.

    Classes are runs of ids, about as many as a class has words; the end and another
    word are classes of their own.
    """

    def __init__(self, known: np.ndarray, counts: np.ndarray, total: int, different: int):
        self.known, self.counts, self.total, self.different = known, counts, total, different
        words = np.flatnonzero(known != END_HASH)
        words = words[np.lexsort((known[words], -counts[words]))]
        top = words[:min(MODEL_WORDS, max(HEAD, int((counts[words] >= LEAST).sum())))]
        self.id_of = np.argsort(known[top])
        self.head = known[top][self.id_of]
        self.size = len(self.head) + 2
        self.end, self.other = len(self.head), len(self.head) + 1
        own = counts[top].astype(np.int64)
        ends = int(counts[known == END_HASH].sum())
        self.other_total = total - int(own.sum()) - ends
        self.other_words = different - len(self.head) - (ends > 0)
        unigram = np.concatenate([own, [ends, self.other_total]]).astype(np.float64) + 1.0
        self.unigram = unigram / unigram.sum()
        in_class = max(1, math.isqrt(len(top)))
        self.first = np.concatenate([np.arange(0, len(top), in_class), [self.end, self.other, self.size]])
        self.class_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.class_unigram = np.add.reduceat(self.unigram, self.first[:-1])
        self.inside = self.unigram / self.class_unigram[self.class_of]

    def slim(self) -> Vocabulary:
        """A copy without the counts of words outside the model."""
        out = copy(self)
        out.known, out.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return out

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.other, dtype=np.int64)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            out = np.where(self.head[at] == h, self.id_of[at], out)
        out[h == END_HASH] = self.end
        return out

    def count(self, h: np.ndarray) -> np.ndarray:
        """Training count of each token; -1 where it is not among the known words."""
        if not len(self.known):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.counts[at], -1)


def _by_row(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sum of the gradients of each."""
    order = np.argsort(rows, kind="stable")
    near = rows[order]
    first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])) if len(near) else np.zeros(0, dtype=np.int64)
    return near[first], np.add.reduceat(grads[order], first, axis=0) if len(near) else grads


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class LogBilinear:
    """P(w | u, v) = P(class of w | u, v) P(w | its class, u, v), both by q = A[u] * a + A[v] * b.

    A class's score is q . R[class] + its bias, a word's in its class q . Q[w] + its
    bias; u and v are the tokens before.  Id ``size`` stands for what is before a text.
    All parameters are rows of one table: (A, Q, bias) of the ids, (R, bias) of the
    classes, and a and b; ``squares`` are AdaGrad's sums.
    """

    def __init__(self, vocabulary: Vocabulary):
        rng = np.random.default_rng(3)
        n, m = vocabulary.size, len(vocabulary.class_unigram)
        self.words = vocabulary
        self.table = np.zeros((n + 1 + m + ORDER, 2 * WIDTH + 1), dtype=np.float32)
        self.table[:, :2 * WIDTH] = rng.normal(0, 0.1, (len(self.table), 2 * WIDTH))
        self.table[:n, -1] = np.log(vocabulary.inside)
        self.table[n + 1:n + 1 + m, -1] = np.log(vocabulary.class_unigram)
        self.table[n + 1 + m:] = 1
        self.squares = np.full_like(self.table, 1e-6)
        self._views()

    def _views(self) -> None:
        n, m = self.words.size, len(self.words.class_unigram)
        for of, name in ((self.table, ""), (self.squares, "_squares")):
            parts = {"A": of[:n + 1, :WIDTH], "Q": of[:n, WIDTH:2 * WIDTH], "bias": of[:n, -1], "R": of[n + 1:n + 1 + m, WIDTH:2 * WIDTH],
                     "class_bias": of[n + 1:n + 1 + m, -1], "C": of[n + 1 + m:, :WIDTH],
                     "word_rows": of[:n, WIDTH:], "class_rows": of[n + 1:n + 1 + m, WIDTH:]}
            for k, part in parts.items():
                setattr(self, k + name, part)

    def flat(self) -> np.ndarray:
        """One row for each of the table's: parameters, then sums of squares."""
        return np.concatenate([self.table, self.squares], axis=1)

    def load(self, flat: np.ndarray) -> LogBilinear:
        """Takes the rows of ``flat``; without sums of squares the model is for scoring only."""
        self.table = flat[:, :2 * WIDTH + 1].copy()
        self.squares = flat[:, 2 * WIDTH + 1:].copy() if flat.shape[1] > 2 * WIDTH + 1 else np.zeros_like(self.table)
        self._views()
        return self

    def context(self, before: np.ndarray) -> np.ndarray:
        out = self.A[before[0]] * self.C[0]
        for k in range(1, ORDER):
            out += self.A[before[k]] * self.C[k]
        return out

    def _move(self, name: str, rows: np.ndarray | slice, g: np.ndarray, n: int) -> None:
        of, squares = getattr(self, name), getattr(self, name + "_squares")
        g = g / np.float32(n)
        own = squares[rows] + g * g
        squares[rows] = own
        np.sqrt(own, out=own)
        g *= np.float32(RATE)
        g /= own
        of[rows] += g

    def trainer(self, seed: tuple[int, ...] = (4,)):
        """A step on ids and what is before them, by AdaGrad; only rows that a batch meets move."""
        rng = np.random.default_rng(seed)
        words = self.words
        log_class = np.log(NOISE * words.class_unigram).astype(np.float32)
        log_inside = np.log(NOISE_INSIDE * words.inside).astype(np.float32)
        upto = np.cumsum(words.unigram)
        below = np.concatenate([[0.0], upto])[words.first]
        every = slice(None)

        def step(ids: np.ndarray, before: np.ndarray) -> None:
            n = len(ids)
            q = self.context(before)
            own = words.class_of[ids]
            noise = rng.choice(len(words.class_unigram), NOISE, p=words.class_unigram)
            R = self.R[own]
            up = 1 - _sigmoid(np.einsum("nw,nw->n", q, R) + self.class_bias[own] - log_class[own])
            down = -_sigmoid(q @ self.R[noise].T + self.class_bias[noise] - log_class[noise])
            dq = up[:, None] * R + down @ self.R[noise]
            rows, g = _by_row(np.concatenate([own, noise]), np.concatenate(
                [np.column_stack([up[:, None] * q, up]), np.column_stack([down.T @ q, down.sum(0)])]).astype(np.float32))

            # Words within their class; the end and another word are alone in theirs.
            at = np.flatnonzero(ids < words.end)
            w, c, qw = ids[at], own[at], q[at]
            drawn = below[c][:, None] + rng.random((len(at), NOISE_INSIDE)) * (below[c + 1] - below[c])[:, None]
            odd = np.clip(np.searchsorted(upto, drawn, side="right"), words.first[c][:, None], words.first[c + 1][:, None] - 1)
            both = np.concatenate([w[:, None], odd], axis=1)
            Q = self.Q[both]
            pull = -_sigmoid(np.matmul(Q, qw[:, :, None])[:, :, 0] + self.bias[both] - log_inside[both])
            pull[:, 0] += 1
            dq[at] += np.matmul(pull[:, None, :], Q)[:, 0]
            pulls = np.empty((*pull.shape, WIDTH + 1), dtype=np.float32)
            np.multiply(pull[:, :, None], qw[:, None, :], out=pulls[:, :, :-1])
            pulls[:, :, -1] = pull
            inner, h = _by_row(both.ravel(), pulls.reshape(-1, WIDTH + 1))

            seen, a = _by_row(before.ravel(), np.concatenate([dq * self.C[k] for k in range(ORDER)]))
            dC = np.stack([(dq * self.A[before[k]]).sum(0) for k in range(ORDER)])
            self._move("class_rows", rows, g, n)
            if len(at):
                self._move("word_rows", inner, h, n)
            self._move("A", seen, a, n)
            self._move("C", every, dC, n)

        return step

    def log10_probabilities(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised: over the classes by a matrix product per run of different contexts, then within each class."""
        n = len(self.A)
        code, where = np.unique(before[0] * n + before[1], return_inverse=True)
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(0, len(code) + BATCH, BATCH))
        contexts = self.context(np.stack([code // n, code % n]))
        classes = self.words.class_of[words]
        out = np.empty(len(words))
        for k in range(0, len(code), BATCH):
            own = order[edges[k // BATCH]:edges[k // BATCH + 1]]
            out[own] = _log_softmax(contexts[k:k + BATCH], self.R, self.class_bias, where[own] - k, classes[own])
        inside = np.flatnonzero(words < self.words.end)
        inside = inside[np.argsort(classes[inside], kind="stable")]
        for run in np.split(inside, np.flatnonzero(np.diff(classes[inside])) + 1) if len(inside) else []:
            a, b = self.words.first[classes[run[0]]:][:2]
            for k in range(0, len(run), BATCH):
                own = run[k:k + BATCH]
                out[own] += _log_softmax(contexts[where[own]], self.Q[a:b], self.bias[a:b], np.arange(len(own)), words[own] - a)
        return out / np.log(10)


def _log_softmax(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    scores = q @ vectors.T
    scores += bias
    own = scores[row, column]
    top = scores.max()
    scores -= top
    np.exp(scores, out=scores)
    total = scores.sum(1)
    if total.min() < 1e-30:  # rows far below the largest score: each by its own
        scores = q @ vectors.T + bias
        high = scores.max(1)
        return own - (np.log(np.exp(scores - high[:, None]).sum(1)) + high)[row]
    return own - (np.log(total) + top)[row]


def _before(ids: np.ndarray, counts: np.ndarray, nothing: int) -> np.ndarray:
    """Ids of the tokens one and two places back, within each text; ``counts`` are the texts' tokens."""
    out = np.full((ORDER, len(ids)), nothing, dtype=np.int64)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    for k in range(ORDER):
        there = np.flatnonzero(place > k)
        out[k, there] = ids[there - k - 1]
    return out


def _weights(vocabulary: Vocabulary, met: np.ndarray, docs: int) -> np.ndarray:
    """Weight of each row of a task's model in the average: how often the task met it."""
    classes = np.add.reduceat(met, vocabulary.first[:-1])
    return np.concatenate([met, [docs], classes, np.full(ORDER, met.sum())]).astype(np.float64)


def _mean(table: pa.Table) -> pa.Table:
    """Weighted mean of one block of rows over the learners, in their order; NaN where none met a row."""
    table = table.sort_by("learner")
    total, weight = 0.0, 0.0
    for w, v in zip(table["w"], table["v"], strict=True):
        w = np.frombuffer(w.as_py(), dtype=np.float64)
        total = total + w[:, None] * np.frombuffer(v.as_py(), dtype=np.float32).reshape(len(w), -1)
        weight = weight + w
    with np.errstate(invalid="ignore"):
        mean = (total / weight[:, None]).astype(np.float32)
    return pa.table({"k": table["k"].slice(0, 1), "v": pa.array([mean.tobytes()], pa.binary())})


def _dealt(folded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(turn, learner, draw, ids) of every training text, stored: its round, its learner, its place there, its ids."""
    shared = folded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for part in texts.slices(texts.column(batch, "text")):
                tokens = Tokens(part)
                ids = words.ids(tokens.hashes).astype("<u2")
                streams = [ids[a:a + n].tobytes() for a, n in zip(tokens.starts.tolist(), tokens.counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(streams, pa.binary())], ["draw", "ids"])

    learners = max(1, -(-vocabulary.total // LEARNER_TOKENS))
    rows = folded.where("not held_out").select(F.xxhash64("doc_id", "text").alias("draw"), "text").mapInArrow(run, "draw long, ids binary")
    return store(rows.select(F.pmod("draw", F.lit(ROUNDS)).cast("int").alias("turn"), F.pmod(F.shiftright("draw", 16), F.lit(learners)).cast("int").alias("learner"),
                             "draw", "ids"), "ids")


def _learner(shared, turn: int):
    """Trains a copy of the shared model on the texts of one learner; gives its rows in blocks, with weights."""
    def learn(table: pa.Table) -> pa.Table:
        words, start = shared.value
        learner = int(table["learner"][0].as_py())
        table = table.sort_by([("draw", "ascending"), ("ids", "ascending")])
        streams = [np.frombuffer(s.as_py(), dtype="<u2") for s in table["ids"]]
        counts = np.array([len(s) for s in streams])
        ids = np.concatenate(streams).astype(np.int64)
        before = _before(ids, counts, words.size)
        model = LogBilinear(words).load(start)
        step = model.trainer((4, turn, learner))
        batches = -(-len(ids) // BATCH)
        for _ in range(min(EPOCHS, max(1, STEPS // batches))):
            for k in range(0, len(ids), BATCH):
                step(ids[k:k + BATCH], before[:, k:k + BATCH])
        rows, weights = model.flat(), _weights(words, np.bincount(ids, minlength=words.size), len(streams))
        first = range(0, len(rows), BLOCK)
        return pa.table({
            "k": pa.array([k // BLOCK for k in first], pa.int32()), "learner": pa.array([learner] * len(first), pa.int32()),
            "v": pa.array([rows[k:k + BLOCK].tobytes() for k in first], pa.binary()), "w": pa.array([weights[k:k + BLOCK].tobytes() for k in first], pa.binary())})

    return learn


def train(folded: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Parameters of the model, by ``ROUNDS`` of training in every learner and averaging.

    A round is a part of the texts.  Learners start from the last average and take the texts
    that their hash deals to them, in the order of the hash, so the model is the same for any
    partitions and cores.  Each row's average is by how often a learner met its word: one
    that never saw a word does not hold it back.
    """
    context = folded.sparkSession.sparkContext
    dealt = _dealt(folded, vocabulary)
    flat = LogBilinear(vocabulary).flat()
    for turn in range(ROUNDS):
        shared = context.broadcast((vocabulary.slim(), flat))
        own = by_block(dealt.where(F.col("turn") == turn).drop("turn"), "learner")
        rows = own.groupBy("learner").applyInArrow(_learner(shared, turn), "k int, learner int, v binary, w binary")
        mean = rows.groupBy("k").applyInArrow(_mean, "k int, v binary").collect()  # the model once
        flat = flat.copy()
        for r in mean:
            old = flat[r["k"] * BLOCK:(r["k"] + 1) * BLOCK]
            new = np.frombuffer(r["v"], dtype=np.float32).reshape(old.shape)
            old[:] = np.where(np.isnan(new), old, new)
        shared.destroy()
    discard(dealt)
    return flat


_PARTIAL = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, tf long")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Trained on all documents whose crc32 of the id has a remainder other than 0 by
    ``FOLDS``.  Tokens are runs without ASCII white space, A-Z lower-cased, and one end
    per text.  ``base_score`` is the smoothed unigram log10 probability; ``score`` that
    of the model, which spells another word as P(another | before) times
    (c + 0.1) / (its total + 0.1 * (its words + 1)).

    Counts are exact over the whole corpus, by 64-bit hashes of words.  Up to ``KNOWN``
    frequent words are looked up in a broadcast table; rarer ones meet their counts in a
    join, summed per document before.  Scores do not depend on partitions or cores, but for
    the last digits of sums.  Null texts count as empty (one end), a null id as
    an empty one, which is held out.  Repeated rows are scored separately and alike.
    With nothing to learn from, every word is another word and every count 0.
    """
    frames.modest_batches(docs.sparkSession)
    spark = docs.sparkSession
    folded = _folded(docs)
    counts = count_words(folded)
    total, different = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known, found = _frequent(counts, KNOWN)
    vocabulary = Vocabulary(known, found, total, different)
    flat = train(folded, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, flat[:, :2 * WIDTH + 1]))
    base_of = total + SMOOTH * (different + 1)
    other_of = vocabulary.other_total + SMOOTH * (vocabulary.other_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, params = shared.value
        model = LogBilinear(words).load(params)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held = batch.column(0), batch.column(1)
            for part in texts.slices(texts.column(batch, "text")):
                tokens = Tokens(part)
                n = len(part)
                c, known_ids = words.count(tokens.hashes), words.ids(tokens.hashes)
                here = c >= 0
                log_c = np.log10(np.maximum(c, 0) + SMOOTH)
                base = np.where(here, log_c, 0.0) - np.log10(base_of)
                own = model.log10_probabilities(known_ids, _before(known_ids, tokens.counts, words.size))
                other = known_ids == words.other
                own += np.where(other, np.where(here, log_c, 0.0) - np.log10(other_of), 0.0)
                rows = row + np.arange(n)
                row += n
                there = slice(part.first, part.first + n)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), ids[there], held[there], pa.array(tokens.counts), pa.array(np.bincount(tokens.doc, here & (c > 0), n).astype(np.int64)),
                     pa.array(np.bincount(tokens.doc, base, n)), pa.array(np.bincount(tokens.doc, own, n)), none, none], _NAMES)
                # Words that are not in the table, once per text.
                rare = np.flatnonzero(~here)
                order = rare[np.lexsort((tokens.hashes[rare], tokens.doc[rare]))]
                h, doc = tokens.hashes[order], tokens.doc[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
                m = len(first)
                empty = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[doc[first]]), *empty, pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h))))], _NAMES)

    partial = store(folded.mapInArrow(run, _PARTIAL), "partial")
    rare = partial.where("h is not null").select("row", "h", "tf")
    met = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log_c = F.col("tf") * F.log10(F.col("c") + SMOOTH)
    more = met.select("row", F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"), log_c.alias("log_c"))
    own = partial.where("h is null")
    rows = own.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").unionByName(
        more.select("row", "n_known", F.col("log_c").alias("base"), F.col("log_c").alias("score")), allowMissingColumns=True)
    summed = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


_NAMES = [field.split()[0] for field in _PARTIAL.split(", ")]
