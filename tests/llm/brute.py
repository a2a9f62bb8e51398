"""Plain versions of packing, ranked search and the prefix trie."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from tests.llm.helpers import PLAIN, lower


def best_layout(at, cost, limit, sequence):
    """Least total cost of windows over the positions, by trying all."""
    best = [0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= limit:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else limit - n) + cost[j] + sequence)
    return best[-1]


def layout_cost(cuts, at, cost, limit, sequence):
    price = dict(zip(at, cost, strict=True))
    return sum((0 if (n := b - a) & (n - 1) == 0 else limit - n) + price[b] + sequence for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def ranked(docs, items, top=10):
    """(item_id, rank, doc_id, score) of the best documents of each item."""
    bags = [(d, Counter(PLAIN.findall(lower(t)))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(PLAIN.findall(lower(t)))
    out = []
    for i, ts in terms.items():
        found = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in ts if b[t])
            if s > 0:
                found.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


def trie(turns, family=100, heads=6):
    """Nodes as (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            tie = hashlib.md5(f"{role or ''}\n{text or ''}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % heads
        whole = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in children[node])
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
