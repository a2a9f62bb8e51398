"""Token ids of whole texts by a public BPE vocabulary, each distinct piece of text encoded once.

The vocabulary's pre-tokenizer never lets a token cross white space, nor the border
between a letter and a sign.  Texts are therefore cut there, and what a task (or an
earlier one of the same worker) has encoded is looked up.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from voxmill.llm import texts

#: Pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 20

_SPACE, _LETTER, _SIGN, _APOSTROPHE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
for _a, _b in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
    _KIND[_a:_b] = _SIGN
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _APOSTROPHE
_ENDS_SENTENCE = np.zeros(256, dtype=bool)
_ENDS_SENTENCE[list(b".!?")] = True
_SPECIAL = b"<|"


def _byte_letters() -> str:
    """The character that a byte-level vocabulary writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return "".join(table[b] for b in range(256))


_BYTE_LETTERS = _byte_letters()


def _cut(data: np.ndarray, offsets: np.ndarray, whole_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces.

    Letters are ASCII letters and the Latin letters of two bytes that begin with C3.  A piece ends
    before white space, between a letter and the signs behind it, and between signs without an
    apostrophe and the letter behind them (an apostrophe may begin a contraction).
    """
    kind = _KIND[data]
    if not whole_words:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[wide] = kind[wide + 1] = _LETTER
    left, right = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = (left == _SPACE) != (right == _SPACE)
    if not whole_words:
        cut[1:-1] |= (left == _LETTER) & ((right == _SIGN) | (right == _APOSTROPHE))
        opening = np.flatnonzero((left == _SIGN) & (right == _LETTER)) + 1
        if len(opening):  # the run of signs before the letter must hold no apostrophe
            quotes = np.flatnonzero(kind == _APOSTROPHE)
            plain = np.flatnonzero((kind != _SIGN) & (kind != _APOSTROPHE))
            run = np.searchsorted(plain, opening)  # the run begins behind plain[run - 1]
            first = np.where(run > 0, plain[np.maximum(run - 1, 0)] + 1, 0) if len(plain) else np.zeros_like(opening)
            clean = np.searchsorted(quotes, first) == np.searchsorted(quotes, opening)
            cut[opening[clean]] = True
    cut[offsets] = True
    at = np.flatnonzero(cut[:-1])
    inside = kind[at] != _SPACE
    return at[inside], np.append(at[1:], len(data))[inside]


class Encoder:
    """Encodes texts; ``vocabulary`` is the content of a tokenizer file."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        """Lower-case Latin words go to the model itself, all else through the whole tokenizer."""
        out: list[list[int] | None] = [None] * len(pieces)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for k, piece in enumerate(pieces):
            if piece.isalpha() and piece.islower():  # bytes: ASCII letters only
                out[k] = [t.id for t in tokenize(piece.decode())]
                continue
            word = piece.decode("utf-8", "replace")
            if word.isalpha() and word.islower() and all("a" <= c <= "z" or "ß" <= c <= "ÿ" for c in word):
                out[k] = [t.id for t in tokenize("".join(_BYTE_LETTERS[b] for b in piece))]
            else:
                rest.append((k, word))
        if rest:
            for (k, _), e in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of each piece stand in the memory; encodes the unknown ones."""
        if len(self.known) + len(pieces) > max(self.remembered, len(pieces)):
            self._forget()
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]  # pieces may differ in the white space behind them only
        if new:
            lists = self._ids_of(new)
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            first, total = len(known), int(lengths.sum())
            for name, need in (("starts", first + len(new)), ("lengths", first + len(new)), ("flat", self.used + total)):
                have = getattr(self, name)
                if need > len(have):
                    setattr(self, name, np.concatenate([have, np.zeros(max(len(have), need - len(have)), have.dtype)]))
            self.flat[self.used:self.used + total] = np.fromiter((i for ids in lists for i in ids), np.uint32, total)
            self.starts[first:first + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first:first + len(new)] = lengths
            self.used += total
            known.update(zip(new, range(first, first + len(new)), strict=True))
        at = [known[p] for p in pieces]
        return np.array(at, dtype=np.int64)

    def encode(self, part: texts.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, the bounds of each text in them, and where sentences end.

        A sentence ends behind . ! or ? before white space or the end, and at a line break.
        """
        none = np.zeros(0, dtype=np.int64)
        data = part.data
        if not len(data):
            return none.astype(np.uint32), np.zeros(len(part) + 1, dtype=np.int64), none
        special = _SPECIAL in data.tobytes()  # such strings keep their case and are not cut
        starts, ends = _cut(data, part.offsets, special)
        if not len(starts):
            return none.astype(np.uint32), np.zeros(len(part) + 1, dtype=np.int64), none
        # Each piece with the white space behind it: then the pieces lie one behind the other.
        tail = np.append(starts, len(data)).astype(np.int64)
        lowered = data if special else texts._LOWER[data]
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(tail), pa.py_buffer(np.ascontiguousarray(lowered))])
        coded = spans.dictionary_encode()
        place = self._places([p.strip(b" \t\n\v\f\r") for p in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[place]
        upto = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[place] - (upto - lengths), lengths) + np.arange(upto[-1])]
        bounds = np.append(0, upto)[np.searchsorted(starts, part.offsets)]
        behind = np.append(data, np.uint8(0x20))[ends]
        text_ends = np.zeros(len(data) + 1, dtype=bool)
        text_ends[part.offsets] = True
        stop = (_ENDS_SENTENCE[data[ends - 1]] & ((_KIND[behind] == _SPACE) | text_ends[ends])) | (behind == 0x0A)
        return ids, bounds, upto[stop]
