"""Vectorised word splitting and hashing over Arrow string columns.

Texts reach a task as Arrow batches.  Their bytes are handled in slices of a few
megabytes, so that NumPy temporaries stay bounded (one longer text is a slice of
its own).  All hashes are 64-bit and depend on the bytes of the words alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once.
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs without ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: As PLAIN (1, with the underscore), and runs of other signs (2); white space is 0.
SIGNS = np.where(PLAIN, 1, np.where(SPACED, 2, 0)).astype(np.uint8)
SIGNS[0x5F] = 1

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8: powers differ early from one another
_UNBASE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grown(which: int, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), wrapping; kept for the next slice."""
    have = _powers[which]
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 2 * SLICE_BYTES:
        _powers[which] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Texts:
    """Some consecutive texts of a batch: ``data`` bytes, ``offsets`` of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def words(self, kind: np.ndarray, lower: bool = True) -> Words:
        return Words(self, kind, lower)


class Words:
    """Words of the texts in order: byte ``starts`` and ``ends``, ``doc`` index.

    ``bounds[i]:bounds[i + 1]`` are the words of text ``i``.
    """

    def __init__(self, texts: Texts, kind: np.ndarray, lower: bool):
        self.data = _LOWER[texts.data] if lower else texts.data
        offsets, n = texts.offsets, len(texts.data)
        cls = kind[texts.data].astype(np.uint8)
        change = np.ones(n + 1, dtype=bool)
        np.not_equal(cls[1:], cls[:-1], out=change[1:n])
        change[offsets] = True
        cuts = np.flatnonzero(change[:n])
        inside = cls[cuts] > 0
        self.starts = cuts[inside]
        self.ends = np.append(cuts[1:], n)[inside] if len(cuts) else cuts
        self.bounds = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One hash per word."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * _grown(0, _BASE, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _grown(1, _UNBASE, n)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def join(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), joined by one space."""
        if i >= j:
            return b""
        if np.all(self.starts[i + 1:j] - self.ends[i:j - 1] == 1):  # one byte between: at most its value differs
            part = self.data[self.starts[i]:self.ends[j - 1]].copy()
            part[self.ends[i:j - 1] - self.starts[i]] = 0x20
            return part.tobytes()
        return b" ".join(self.word(k) for k in range(i, j))

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one text, and where each starts."""
        if len(h) < n:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[:len(h) - n + 1] == self.doc[n - 1:])
        acc = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            acc *= _GRAM
            acc += h[k:len(h) - n + 1 + k]
        return mix(acc)[at], at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column, nulls as empty texts; shares the batch's memory where nothing is null."""
    texts = batch.column(batch.schema.get_field_index(name))
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    return pc.fill_null(texts, "") if texts.null_count else texts


def slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut an array of strings into runs of at most ``budget`` bytes (or one text)."""
    n = len(texts)
    if n == 0:
        return
    _, offs, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offs, dtype=wide)[texts.offset:texts.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, side="right")) - 1)
        yield Texts(whole[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i)
        i = j
    pa.default_memory_pool().release_unused()  # earlier batches' memory goes back to the system


def shingles(words: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles and their text; a text of 1 to n-1 words is one shingle."""
    grams, at = words.grams(h, n)
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return grams, words.doc[at]
    extra = np.zeros(len(short), dtype=np.uint64)
    for k in range(n - 1):
        more = counts[short] > k
        extra[more] = extra[more] * _GRAM + h[words.bounds[short[more]] + k]
    grams = np.concatenate([grams, mix(extra + np.uint64(n))])
    doc = np.concatenate([words.doc[at], short])
    order = np.argsort(doc, kind="stable")
    return grams[order], doc[order]


def digest(*parts: bytes) -> bytes:
    """128 bits of any number of byte strings."""
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.digest()


def appended(batch: pa.RecordBatch, schema: pa.Schema, *arrays: pa.Array) -> pa.RecordBatch:
    """The batch with further columns, under ``schema``."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=schema)
