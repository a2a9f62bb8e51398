"""Secret scans: fixed patterns, and an assignment-aware reading of source and configuration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import frames, texts

# The patterns of the contract, and the order in which kinds are listed.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
MIN_VALUE = 6

#: Parts of a name that make its value sensitive, and what each is worth.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 2,
    "credentials": 2, "auth": 1, "authorization": 2, "bearer": 2, "private": 1, "access": 1, "signing": 1, "encryption": 1,
    "api": 1, "client": 1, "key": 1, "pass": 2, "pin": 1, "salt": 1, "session": 1, "cookie": 1,
}
#: Parts that say the value is about a secret rather than being one.
HARMLESS = frozenset("count counts length len size max min limit limits type name names field label url uri path file id ids index "
                     "hint policy regex pattern format expiry expires ttl timeout public column header prefix suffix".split())
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|0+|none|null|true|false|undefined|changeme|example|placeholder|todo|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$")
ENOUGH = 5.0
#: Least score of a bare value without a digit, which may be a word or a name.
BARE = 3.0

_SEPARATOR = re.compile(r"[:=]")
_NAME = re.compile(r"""(?:^|[^\w.\-$])(["']?)([A-Za-z_$][\w.\-$]*)\1[ \t]*:?$""", re.ASCII)
#: The key of a subscript: name["key"].
_KEY = re.compile(r'''\[[ \t]*(["'])([A-Za-z_$][\w.\-$]*)\1[ \t]*\][ \t]*:?$''', re.ASCII)
#: A name with its type: name: type, or var name type.
_TYPED = re.compile(r'''(?:^|[^\w.\-$])(?:([A-Za-z_$][\w$]*)[?!]?[ \t]*:|(?:var|const|let)[ \t]+([A-Za-z_$][\w$]*)[ \t])[ \t]*&?[A-Za-z_][\w.:]*'''
                    r'''(?:[\[<][\w., \t|:<>\[\]'&"]*[\]>])?(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*)*\??[ \t]*$''', re.ASCII)
_OPERAND = re.compile(r'''[ \t]*(?:[rbufRBUF]{0,2}\"""((?:[^"\\]|\\.|"(?!""))*)\"""|[rbufRBUF]{0,2}\'\'\'((?:[^'\\]|\\.|'(?!''))*)\'\'\''''
                      r'''|[rbufRBUF]{0,2}"((?:[^"\\\n]|\\[^\n])*)"|[rbufRBUF]{0,2}'((?:[^'\\\n]|\\[^\n])*)'|`([^`\n]*)`|([A-Za-z0-9_$+/.\-]+=*))''', re.ASCII | re.DOTALL)
_BARE_GROUP = 6
#: A line that is a name so far, as in settings; and what may follow a bare value there.
_SETTING = re.compile(r'''(?:^|\n)[ \t]*(?:(?:export|set)[ \t]+|-[ \t]+)?["']?[\w.\-]+["']?$''', re.ASCII)
_LINE_END = re.compile(r"[ \t]*(?:[#;][^\n]*)?\r?(?:\n|\Z)")
#: A sum, or another choice, of operands; and literals that follow one another.
_PLUS = re.compile(r"[ \t]*(?:\+|\|\||\?\?|(?<=[ \t])or(?=[ \t]))(?=[ \t]*[\"'`A-Za-z_$])")
_NEXT = re.compile(r"[ \t]*(?=[\"'])")
_OPENING = re.compile(r"[ \t]*\((?=[ \t]*[\"'`(])")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How far back a declaration is read, beyond blanks and the whole of a name or type that begins farther back.
_LOOK_BACK = 120
_NAME_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-$")


class _Before:
    """What precedes a separator; names of any length are whole, in time linear in the text."""

    def __init__(self, text: str):
        self.text, self.low, self.high = text, 0, -1  # the last name that was followed back, from low to high

    def __call__(self, at: int) -> str:
        text, end = self.text, at
        while end and text[end - 1] in " \t":
            end -= 1
        start = max(0, end - _LOOK_BACK)
        if self.low <= start <= self.high:
            start = self.low
        elif start and text[start] in _NAME_LETTERS:
            self.high = start
            while start and text[start - 1] in _NAME_LETTERS:
                start -= 1
            self.low = start
        return text[start:end]


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    cut_from: int  # where the value begins, which is what redaction removes


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    found = [Span(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [Span(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def name_score(name: str) -> float:
    """How sensitive a target name is; 0 if it is about something else."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = "".join(parts[-2:])
    if not parts or HARMLESS & set(parts):
        return 0.0
    return float(max(sum(SENSITIVE.get(p, 0) for p in parts), SENSITIVE.get(joined, 0)))


def literal_score(value: str) -> float:
    """How much a literal looks like a generated value: length, mixture, entropy."""
    if len(value) < MIN_VALUE or PLACEHOLDER.match(value) or len(set(value)) < 4 or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return 1.0 + min(bits, 4.0) / 2 + 0.5 * (kinds - 1) + min(n, 32) / 32


def literal_spans(text: str) -> list[Span]:
    """Literals bound to sensitive names, directly or through other names.

    Reads ``name = value``, ``name: value``, ``name := value``, ``name => value``, and
    ``"name"``, ``x["name"]``, ``name: type`` or ``var name type`` in the name's place.
    A value is a literal in quotes or triple quotes, a bare one, a known name, or a sum
    of these, or a choice by ``||``, ``??`` or ``or``; literals may stand in parentheses
    and follow one another; a bare one without a digit has to be all of a setting's line.  A name
    keeps the literals of its last binding, so a literal counts for every name that it
    reaches; the most sensitive of them scores it.
    """
    bound: dict[str, int] = {}  # a name's last binding
    pieces: list[list[tuple[int, int] | int]] = []  # of each binding: literals, and bindings that it takes up
    told: list[float] = []
    behind = -1
    before_at = _Before(text)
    for m in _SEPARATOR.finditer(text):
        at = m.start()
        if at < behind or text[at + 1:at + 2] in ("=", ":") and text[at] == text[at + 1:at + 2]:
            continue
        before = before_at(at)
        left = _KEY.search(before) or _NAME.search(before)
        if text[at - 1:at] in ("!", "<", ">", "=") and not (text[at] == "=" and _TYPED.search(before)):
            continue
        name, found, pos = left[2] if left else None, [], at + 1
        arrow = text[at] == "=" and text[pos:pos + 1] == ">"
        if text[at] == "=" and not arrow and (typed := _TYPED.search(before)):
            name = typed[1] or typed[2]
        if name is None:
            continue
        if arrow or text[at] == ":" and text[pos:pos + 1] == "=":
            pos += 1
        while opening := _OPENING.match(text, pos):
            pos = opening.end()
        while operand := _OPERAND.match(text, pos):
            group = operand.lastindex
            value, start, pos = operand[group], operand.start(group), operand.end()
            if group == _BARE_GROUP and value in bound:
                found.append(bound[value])
            elif group != _BARE_GROUP:
                inner = value.strip() if group < 3 else value
                start += value.index(inner)
                found.append((start, start + len(inner)))
            elif not arrow and (any(c.isdigit() for c in value) or not found and literal_score(value) >= BARE
                                and (text[at] == ":" or start == at + 1) and text[at - 1:at] not in (" ", "\t") and _SETTING.search(before) and _LINE_END.match(text, pos)):
                found.append((start, pos))
            plus = _PLUS.match(text, pos) or group != _BARE_GROUP and _NEXT.match(text, pos)
            if not plus:
                break
            pos = plus.end()
        if not found:
            continue
        behind = pos if text[pos - 1:pos] in "\"'`" else at
        bound[name] = len(pieces)
        pieces.append(found)
        told.append(name_score(name))
    # Bindings take up earlier ones only: from the last to the first, each passes on the best name that it reaches.
    best: dict[tuple[int, int], float] = {}
    for k in range(len(pieces) - 1, -1, -1):
        for piece in pieces[k]:
            if isinstance(piece, int):
                told[piece] = max(told[piece], told[k])
            elif told[k] >= 2:
                best[piece] = max(best.get(piece, 0.0), told[k])
    scored = ((a, b, told_of, literal_score(text[a:b])) for (a, b), told_of in sorted(best.items()))
    return [Span(a, b, "literal", a) for a, b, name, value in scored if value and name + value >= ENOUGH]


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): literals inside a base span are not told again."""
    base = base_spans(text)
    if ":" not in text and "=" not in text:
        return base, base
    more, k, reach = [], 0, -1
    for s in literal_spans(text):
        while k < len(base) and base[k].start <= s.start:
            reach = max(reach, base[k].end)
            k += 1
        if s.end > reach:
            more.append(s)
    return base, sorted([*base, *more], key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


MASK = "[SECRET]"


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each value replaced by a mask; overlapping values share one."""
    out, at = [], 0
    for a, b in sorted((s.cut_from, s.end) for s in spans):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


NEW = ("n_assign", "n_access", "n_hex", "n_literal", "base_spans", "spans", "clean_text")


def scan(docs: DataFrame, redact: bool = True) -> DataFrame:
    """``docs`` with the secrets of each ``text``.

    New columns: ``n_assign``, ``n_access``, ``n_hex``, ``n_literal`` (long),
    ``base_spans`` and ``spans`` (``kind:start:end`` in code points, comma-joined) and
    ``clean_text``, the text with the values masked (null if ``redact`` is False or the
    text is null).  Null and empty texts have no spans; rows are judged one by one, so
    repeated rows get equal results.  Earlier columns of the new names are replaced.
    """
    frames.modest_batches(docs.sparkSession)
    docs = frames.fresh(docs, *NEW)
    name = {c.lower(): c for c in docs.columns}["text"]
    long, string = T.LongType(), T.StringType()
    schema = frames.with_columns(docs, **dict.fromkeys(NEW[:4], long), **dict.fromkeys(NEW[4:], string))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in NEW]
            for value in batch.column(batch.schema.get_field_index(name)):
                text = value.as_py()
                base, every = spans_of(text or "")
                kinds = Counter(s.kind for s in every)
                clean = None if text is None or not redact else redacted(text, every) if every else text
                for column, cell in zip(rows, (*(kinds[k] for k in KINDS), joined(base), joined(every), clean), strict=True):
                    column.append(cell)
            arrays = [pa.array(r, pa.int64()) for r in rows[:4]] + [pa.array(r, pa.string()) for r in rows[4:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *NEW])

    return docs.mapInArrow(run, schema)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret value in ``text`` masked; no row or column comes or goes."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("text"))
    columns = [F.col("clean_text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return scan(rows).select(*columns)
