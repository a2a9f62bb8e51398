"""HTML extraction: blocks of each page, and a suffix array per host that finds boilerplate."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm import frames, texts, urls
from voxmill.session import by_block, store

#: Pages of one host, and bytes of html, that share a suffix array.
SHARD, SHARD_BYTES = 256, 16 << 20
#: Streams that a task remembers in order to tell copies once.
_SEEN = 1 << 18
#: Tokens of the shortest repeated substring; the edge of a block counts as a token.
RUN = 6
#: Distinct pages that must share a substring, outside and inside an article.
PAGES, PAGES_INSIDE = 3, 8
#: Share of a host's pages that must share it, outside and inside an article.
SOME, OFTEN = 0.02, 0.5
#: Share of a block's tokens that repeated substrings cover in boilerplate.
COVER = 0.9
#: Share of a page's text that an article must hold for the rest to go, or a marked wrapper to stay.
MOST = 0.5

# Places of a block: known boilerplate, inside the article, anywhere else.
CHROME, INSIDE, OUTSIDE = 0, 1, 2

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_TEXT = frozenset("head nav footer aside form button select option menu dialog svg math canvas object audio video map".split())
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
                   "notice notices alert disclaimer sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead "
                   "footer comment comments commentlist respond reply replies discussion disqus newsletter subscribe subscription signup login popup "
                   "modal overlay share sharing social related recommended widget toolbar skip hidden".split())
#: Words of a class that say what an element is wherever they stand in it (ad-slot, cookie-bar).
_LEADING = frozenset("ad ads adsense advert advertisement cookie cookies gdpr sidebar navbar nav breadcrumb breadcrumbs newsletter comment comments disqus".split())
#: Words of a class that turn it into a statement about the page's layout (has-sidebar, comments-open).
_LAYOUT = frozenset("has no not non with without is open closed enabled disabled on off active left right".split())
#: Words of a class that make a header part of what it heads (entry-header).
_HEADED = frozenset("entry post article story content section card recipe product".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note".split())
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LASTING = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
_HEADER = frozenset(("header", "masthead"))

# What an element is: nothing, boilerplate, boilerplate if its text is not most of the page's, reader comments.
NOTHING, SURE, LIKELY, LASTING = 0, 1, 2, 3


def _meaning(token: str, inside: bool) -> int:
    """What one class or id says: its last word counts, leading words of a few kinds too."""
    parts = [p for p in _SPLIT.split(_CAMEL.sub(" ", token).lower()) if p]
    if not parts:
        return NOTHING
    if len(parts) > 1 and parts[0] in ("has", "no", "not", "non", "with", "without"):
        return NOTHING
    side = len(parts) > 1 and parts[-1] in ("left", "right")
    if len(parts) > 1 and parts[-1] in _LAYOUT and not side:
        return NOTHING
    last = parts[-2] if side else parts[-1]
    joined = "".join(parts)
    told = {w for w in (last, joined) if w in _WORDS} | ({parts[0]} & _LEADING)
    if told <= _HEADER and (inside or set(parts) & _HEADED):
        return NOTHING
    return LASTING if told & _LASTING else LIKELY if told else NOTHING


def _chrome(name: str, attributes: str, inside: bool) -> int:
    if name in _NOT_TEXT:
        return LIKELY if name == "form" else SURE
    if name == "header" and not inside:
        return LIKELY
    if name in ("html", "body", "main") or not attributes:
        return NOTHING
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    kind = max((_meaning(t, inside) for t in [*found.get("class", "").split(), *found.get("id", "").split()]), default=NOTHING)
    if kind == LASTING:
        return LASTING
    if name == "article":
        return NOTHING
    if "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        return SURE
    return LIKELY if kind or found.get("role", "").lower() in _ROLES or found.get("aria-hidden") == "true" else NOTHING


class _Open:
    """Open elements that matter: boilerplate, articles, and elements named like open boilerplate."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []  # name, kind (-1: only named alike), number of the boilerplate
        self.at: dict[str, list[int]] = {}
        self.articles: list[int] = []
        self.chrome: list[int] = []  # numbers of the open boilerplate

    def push(self, name: str, kind: int, number: int = -1) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if kind == NOTHING:
            self.articles.append(len(self.stack))
        elif kind > 0:
            self.chrome.append(number)
        self.stack.append((name, kind, number))

    def pop(self) -> None:
        name, kind, _ = self.stack.pop()
        self.at[name].pop()
        if kind == NOTHING:
            self.articles.pop()
        elif kind > 0:
            self.chrome.pop()

    def end(self, name: str) -> None:
        """Closes the last open element of the name; one outside an open article only if the article's own end, or the page's, comes."""
        places = self.at.get(name)
        if not places or self.articles and places[-1] < self.articles[-1] and name not in ("body", "html", "article", "main"):
            return
        while len(self.stack) > places[-1] + 1:
            self.pop()
        self.pop()

    def top(self, name: str) -> bool:
        return bool(self.stack) and self.stack[-1][0] == name and self.stack[-1][1] > 0


def blocks(html: str) -> tuple[list[str], list[int]]:
    """Visible blocks of a page in order, and the place of each.

    A block ends wherever an element begins or ends that is not part of a line of text.
    Unclosed elements end with what holds them; ``article`` and ``main`` end boilerplate
    that was left open before them, unless it is reader comments.  An element that only
    its class, its role or a form marks is no boilerplate if it holds more than ``MOST``
    of the page's text and there is no article beside it: it wraps the page.
    """
    out: list[str] = []
    inner: list[bool] = []
    within: list[tuple[int, ...]] = []  # of each block: numbers of the boilerplate around it
    line: list[str] = []
    kinds: list[int] = []  # of each boilerplate
    opened = _Open()
    around: tuple[int, ...] = ()
    pos = 0

    def flush() -> None:
        text = " ".join(unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)
            inner.append(bool(opened.articles))
            within.append(around)

    def begin(name: str, kind: int) -> None:
        kinds.append(kind)
        opened.push(name, kind, len(kinds) - 1)

    def surrounding() -> tuple[int, ...]:
        # Boilerplate that cannot be told from its text ends the search: what is around it does not matter.
        found: list[int] = []
        for number in reversed(opened.chrome):
            found.append(number)
            if kinds[number] != LIKELY or len(found) == _DEPTH:
                break
        return tuple(found)

    while m := _TAG.search(html, pos):
        line.append(html[pos:m.start()])
        pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            if name == "br":
                line.append(" ")
            elif not m[1] and m[3] and name != "a" and (kind := _chrome(name, m[3], bool(opened.articles))):
                flush()
                begin(name, kind)
                around = surrounding()
            elif m[1] and opened.top(name):
                flush()
                opened.pop()
                around = surrounding()
            continue
        flush()
        if m[1]:
            opened.end(name)
            around = surrounding()
            continue
        if name in _RAW:
            end = _RAW[name].search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if name in _VOID or m[3].rstrip().endswith("/"):
            continue
        if name in ("p", "li", "dd", "dt", "tr", "td", "th") and opened.top(name):
            opened.pop()
        kind = _chrome(name, m[3], bool(opened.articles))
        if name in ("article", "main") and not kind:
            while opened.stack and opened.stack[-1][1] in (SURE, LIKELY):
                opened.pop()
            opened.push(name, NOTHING)
        elif kind:
            begin(name, kind)
        elif opened.chrome and opened.at.get(name):
            opened.push(name, -1)  # a nested element of the same name: its end is not the outer one's
        around = surrounding()
    line.append(html[pos:])
    flush()
    return out, _places(out, inner, within, kinds)


#: Nested boilerplate that is looked at around a block; what lies deeper is boilerplate.
_DEPTH = 16


def _places(out: list[str], inner: list[bool], within: list[tuple[int, ...]], kinds: list[int]) -> list[int]:
    sizes = [len(t) for t in out]
    held = [0] * len(kinds)
    for n, numbers in zip(sizes, within, strict=True):
        for number in numbers:
            held[number] += n
    article = sum(n for n, i, numbers in zip(sizes, inner, within, strict=True) if i and not numbers)
    total = sum(n for n, numbers in zip(sizes, within, strict=True) if not numbers or kinds[numbers[-1]] == LIKELY)
    wraps = [kind == LIKELY and not article and h > MOST * total for kind, h in zip(kinds, held, strict=True)]
    return [CHROME if len(numbers) == _DEPTH or not all(wraps[k] for k in numbers) else INSIDE if i else OUTSIDE
            for i, numbers in zip(inner, within, strict=True)]


def _parse(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [blocks(h or "") for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int8()))], names)
    return run


def streams(pages: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tokens of each page, 32-bit hashes of its words with 0 at the edges of blocks, and the block of each token (-1: edge)."""
    out = []
    for part in texts.slices(pa.array(["\n".join(p) for p in pages], pa.large_string())):
        words = part.words(texts.SPACED, lower=False)
        hashes = (words.hashes() % np.uint64((1 << 32) - 1) + np.uint64(1)).astype("<u4")
        for i in range(len(part)):
            sizes = np.array([b.count(" ") + 1 for b in pages[part.first + i]], dtype=np.int64)
            ends = np.cumsum(sizes)
            own = np.insert(np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], ends]), -1)
            out.append((np.insert(hashes[words.bounds[i]:words.bounds[i + 1]], np.concatenate([[0], ends]), 0), own))
    return out


def _runs(tokens: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``RUN`` tokens from each place of one stream on."""
    n = max(0, len(tokens) - RUN + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(RUN):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + texts.mix(tokens[k:n + k].astype(np.uint64) + np.uint64(k + 1))
    return texts.mix(acc)


def _spread(score: np.ndarray, run: int) -> np.ndarray:
    """Of each token the best score of the substrings of ``run`` tokens that hold it."""
    best = score.copy()
    for k in range(1, run):
        best[k:] = np.maximum(best[k:], score[:-k])
    return best


def shared_runs(pages: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, int]:
    """For each place of the concatenated streams, how many pages share the ``run`` tokens from there on; and the different pages.

    Sorting suffixes by their first ``run`` tokens, doubled from rank to rank, puts equal
    substrings together.  A substring lies within one page (0 elsewhere).  Pages of equal
    streams count once, so that copies of an article are no boilerplate.
    """
    alike: dict[bytes, int] = {}
    sizes = [len(p) for p in pages]
    who = np.repeat([alike.setdefault(p.tobytes(), k) for k, p in enumerate(pages)], sizes)
    page = np.repeat(np.arange(len(pages)), sizes)
    rank = np.unique(np.concatenate(pages), return_inverse=True)[1].astype(np.int64)
    n, reach = len(rank), 1
    while reach < run:
        step = min(reach, run - reach)
        after = np.zeros(n, dtype=np.int64)
        after[:n - step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int64)
        reach += step
    whole = np.zeros(n, dtype=bool)
    whole[:max(0, n - run + 1)] = page[:max(0, n - run + 1)] == page[run - 1:]
    met = np.unique(rank[whole] * len(pages) + who[whole]) // len(pages)
    return np.where(whole, np.bincount(met, minlength=int(rank.max()) + 1)[rank], 0), len(alike)


def repeated(pages: list[list[str]], run: int = RUN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each page, the pages that share each token's best repeated substring, and each token's block."""
    found = streams(pages)
    best = _spread(shared_runs([t for t, _ in found], run)[0], run)
    return list(zip(np.split(best, np.cumsum([len(t) for t, _ in found])[:-1]), (b for _, b in found), strict=True))


def _needed(different: int) -> tuple[int, int]:
    """Pages of a host that must share a substring: outside and inside an article."""
    return max(PAGES, math.ceil(SOME * different)), max(PAGES_INSIDE, math.ceil(OFTEN * different))


def _main(texts_of: list[str], places: list[int], best: np.ndarray, block: np.ndarray, needed: tuple[int, int]) -> list[str]:
    """The blocks of one page's main text; ``best`` is each token's number of sharing pages."""
    if not texts_of:
        return []
    own, n = block >= 0, len(texts_of)
    enough = np.where(np.array(places) == INSIDE, needed[1], needed[0])
    size = np.bincount(block[own], minlength=n)
    plate = np.bincount(block[own], best[own] >= enough[block[own]], minlength=n) >= COVER * size
    left = [k for k in range(n) if places[k] != CHROME and not plate[k]]
    article = sum(len(texts_of[k]) for k in left if places[k] == INSIDE)
    alone = article > 0 and article >= MOST * sum(len(texts_of[k]) for k in left)
    return [texts_of[k] for k in left if places[k] == INSIDE or not alone]


def main_blocks(pages: list[tuple[list[str], list[int]]]) -> list[list[str]]:
    """The blocks of each page's main text, judged among all pages of one host."""
    if not pages:
        return []
    found = streams([b for b, _ in pages])
    counts, different = shared_runs([t for t, _ in found])
    best = np.split(_spread(counts, RUN), np.cumsum([len(t) for t, _ in found])[:-1])
    return [_main(b, p, s, o, _needed(different)) for (b, p), s, (_, o) in zip(pages, best, found, strict=True)]


def _different(table: pa.Table) -> list[np.ndarray]:
    """The different streams of a shard; a host's copies of one are all in the same shard."""
    return [np.frombuffer(t, dtype="<u4") for t in sorted(set(table["stream"].to_pylist()))]


def _evidence(table: pa.Table) -> pa.Table:
    """Of one shard, the substrings that two of its different pages share, in a shard of up to 1 / ``SOME`` pages all: (host, run, n, slack).

    ``slack`` is the most pages on which a substring can be in the shard without being told; with a
    null run stands the number of the shard's different pages.
    """
    pages = _different(table)
    counts, different = shared_runs(pages)
    least = 2 if SOME * different > 1 else 1
    runs = np.concatenate([np.concatenate([_runs(p), np.zeros(min(len(p), RUN - 1), dtype=np.uint64)]) for p in pages])
    often = np.flatnonzero(counts >= least)
    run, first = np.unique(runs[often], return_index=True)
    return pa.table({"host": pa.repeat(table["host"][0], len(run) + 1).cast(pa.string()),
                     "run": pa.array([None, *run.view(np.int64).tolist()], pa.int64()),
                     "n": pa.array([different, *counts[often][first].tolist()], pa.int64()),
                     "slack": pa.repeat(pa.scalar(least - 1, pa.int64()), len(run) + 1)})


def _recount(table: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one shard, the different pages that hold each asked substring: (host, run, n)."""
    run = np.sort(np.array(asked["runs"][0].as_py() if asked.num_rows else [], dtype=np.int64).view(np.uint64))
    n = np.zeros(len(run), dtype=np.int64)
    for page in _different(table) if len(run) else []:
        own = np.unique(_runs(page))
        at = np.minimum(np.searchsorted(run, own), len(run) - 1)
        n[at[run[at] == own]] += 1
    host = pa.repeat(asked["host"][0], len(run)).cast(pa.string()) if len(run) else pa.array([], pa.string())
    return pa.table({"host": host, "run": pa.array(run.view(np.int64)), "n": pa.array(n)})


def _by_host_runs(judged: list[tuple[list[str], list[int]]], run: np.ndarray, n: np.ndarray, needed: tuple[int, int]) -> list[list[str]]:
    """As ``main_blocks``, with a host's substrings (``run``, ascending) and their pages ``n``."""
    out = []
    for (b, p), (tokens, block) in zip(judged, streams([b for b, _ in judged]), strict=True):
        own = _runs(tokens)
        at = np.minimum(np.searchsorted(run, own), max(0, len(run) - 1))
        score = np.zeros(len(tokens), dtype=np.int64)
        if len(run):
            score[:len(own)] = np.where(run[at] == own, n[at], 0)
        out.append(_main(b, p, _spread(score, RUN), block, needed))
    return out


def _shards(pages: DataFrame) -> DataFrame:
    """(host, shards): how many suffix arrays the pages of a host are dealt to."""
    size = F.greatest(F.ceil(F.count("*") / SHARD), F.ceil(F.coalesce(F.sum(F.length("html")), F.lit(0)) / SHARD_BYTES), F.lit(1))
    return store(pages.groupBy("host").agg(size.cast("int").alias("shards")), "hosts")


def _streams(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, shard, stream): token streams of the pages of the hosts in ``sizes``, dealt by stream, so that equal ones meet.

    A task tells a stream of a host once among some ``_SEEN`` streams, so that copies do not gather in a shard.
    """
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for batch in batches:
            found = [t.tobytes() for t, _ in streams([blocks(h or "")[0] for h in batch.column(2).to_pylist()])]
            keys = [hashlib.blake2b(t, digest_size=16).digest() for t in found]
            new = []
            for k, known in enumerate(zip(batch.column(0).to_pylist(), keys, strict=True)):
                if known not in seen:
                    seen.add(known)
                    new.append(k)
            if len(seen) > _SEEN:
                seen.clear()
            part = pa.array([int.from_bytes(keys[k][:7], "little") for k in new], pa.int64())
            at = pa.array(new, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), part, pa.array([found[k] for k in new], pa.binary())],
                                             ["host", "shards", "part", "stream"])

    told = rows.join(frames.lookup(sizes), "host").select("host", F.col("shards").cast("long"), "html")
    told = told.mapInArrow(tokens, "host string, shards long, part long, stream binary")
    return by_block(told.select("host", (F.col("part") % F.col("shards")).alias("shard"), "stream"), "host", "shard")


def _host_runs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, pages, runs, counts) of the hosts of several shards: their different pages and the substrings that are boilerplate.

    A substring on ``SOME`` of a host's pages is on ``SOME`` of some shard's, so it is told at least
    once.  Where the pages that were told and those that may not have been leave a verdict open, the
    substring is counted once more in all shards; so the verdicts are those of one count over the host.
    """
    large = sizes.where("shards > 1")
    told = _streams(rows, large).groupBy("host", "shard").applyInArrow(_evidence, "host string, run long, n long, slack long")
    summed = store(told.groupBy("host", "run").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")), "runs")
    pages = summed.where("run is null").select("host", F.col("n").alias("pages"), F.col("slack").alias("most"))
    needed = [F.greatest(F.lit(least), F.ceil(F.col("pages") * share)) for least, share in ((PAGES, SOME), (PAGES_INSIDE, OFTEN))]
    found = summed.where("run is not null").join(frames.lookup(pages), "host")
    upto = F.col("n") + F.col("most") - F.col("slack")
    unsure = ((F.col("n") < needed[0]) & (upto >= needed[0])) | ((F.col("n") < needed[1]) & (upto >= needed[1]))
    open_ = store(found.where(unsure).select("host", "run"), "unsure")
    often = found.where((F.col("n") >= needed[0]) & ~unsure).select("host", "run", "n")
    if not open_.isEmpty():
        asked = open_.groupBy("host").agg(F.collect_list("run").alias("runs"))
        some = store(asked.join(large, "host"), "asked")
        spread = some.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)))
        spread = by_block(spread.select("host", "shard", "runs"), "host", "shard").groupBy("host", "shard")
        again = _streams(rows, some.select("host", "shards")).groupBy("host", "shard").cogroup(spread).applyInArrow(_recount, "host string, run long, n long")
        again = again.groupBy("host", "run").agg(F.sum("n").alias("n")).join(frames.lookup(pages), "host")
        often = often.unionByName(again.where(F.col("n") >= needed[0]).select("host", "run", "n"))
    runs = often.groupBy("host").agg(F.collect_list(F.struct("run", "n")).alias("runs"))
    return pages.join(runs, "host", "left").select("host", "pages", F.col("runs.run").alias("runs"), F.col("runs.n").alias("counts"))


def _shard() -> Column:
    return F.pmod(F.xxhash64("page_id", "url"), F.col("shards"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, text, n_chars): main text of every page; other columns go.

    Markup gives blocks and says what some of them are: navigation, headers, footers,
    adverts, notices, forms, comments (by element, role, class or id), and what is in an
    ``article`` or ``main``.  The pages of a host, in shards of about ``SHARD`` by hash,
    are token streams under a suffix array each; their counts of common substrings are added
    up over the shards of the host, and taken again where the sum leaves a verdict open, so the
    verdicts do not depend on the number of shards.  A block
    that is covered by substrings on ``PAGES`` different pages and ``SOME`` of the host's
    is boilerplate (inside an article: ``PAGES_INSIDE`` and ``OFTEN``), alike on all pages
    of the host.  Left are the article's other blocks if they are ``MOST`` of the text
    that is left, else all other blocks.  White space inside a block is one space; blocks
    are joined by a line feed.

    Null and empty pages give an empty text, a null url an empty host (such pages are
    one host).  Repeated rows and copies of a page count once on a host and are each
    returned.  The blocks are moved once, those of hosts of several shards also as
    tokens; a host of any size is spread over its shards.  A host has at most 1/``SOME``
    times a page's tokens of common substrings, which each of its shards reads.
    """
    frames.modest_batches(pages.sparkSession)
    names = {c.lower(): c for c in pages.columns}
    rows = pages.select(*(F.col(f"`{names[c]}`").alias(c) for c in ("page_id", "url")), urls.host_of(F.col(f"`{names['url']}`")).alias("host"),
                        F.col(f"`{names['html']}`").cast("string").alias("html"))
    sizes = _shards(rows)
    known = store(_host_runs(rows, sizes), "boilerplate") if sizes.where("shards > 1").limit(1).count() else None
    columns = ["page_id", "url", "host", "blocks", "places"]
    id_type, url_type = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()
    parsed = rows.mapInArrow(_parse(columns), f"page_id {id_type}, url {url_type}, host string, blocks array<string>, places array<tinyint>")
    placed = parsed.join(frames.lookup(sizes), "host").withColumn("shard", _shard())
    result = f"page_id {id_type}, url {url_type}, host string, text string, n_chars long"

    def told(table: pa.Table, kept: list[list[str]]) -> pa.Table:
        text = ["\n".join(k) for k in kept]
        return pa.table({"page_id": table["page_id"], "url": table["url"], "host": table["host"], "text": pa.array(text, pa.string()),
                         "n_chars": pa.array([len(t) for t in text], pa.int64())})

    def read(table: pa.Table) -> list[tuple[list[str], list[int]]]:
        return list(zip(table["blocks"].to_pylist(), table["places"].to_pylist(), strict=True))

    if known is None:
        return by_block(placed, "host", "shard").groupBy("host", "shard").applyInArrow(lambda t: told(t, main_blocks(read(t))), result)

    def judge(table: pa.Table, runs: pa.Table) -> pa.Table:
        if not table.num_rows or not runs.num_rows:
            return told(table, main_blocks(read(table)))
        run = np.array(runs["runs"][0].as_py() or [], dtype=np.int64).view(np.uint64)
        n = np.array(runs["counts"][0].as_py() or [], dtype=np.int64)
        order = np.argsort(run)
        return told(table, _by_host_runs(read(table), run[order], n[order], _needed(runs["pages"][0].as_py())))

    spread = known.join(sizes, "host").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)))
    spread = by_block(spread.select("host", "shard", "pages", "runs", "counts"), "host", "shard")
    return by_block(placed, "host", "shard").groupBy("host", "shard").cogroup(spread.groupBy("host", "shard")).applyInArrow(judge, result)
