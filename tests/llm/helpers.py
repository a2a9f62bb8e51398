"""Small corpora and brute-force versions of the operators."""

import hashlib
import itertools
import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été über niño".split()
DOCS = "doc_id long, text string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1):
    """Rows with exact and near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 70)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[7].upper(), texts[11].replace(" ", "\t", 3)]
    for k in (5, 5, 9):
        words = texts[k].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 30)}" for _ in range(6)]
    texts += ["", None, " \t\n", "one two", "one two", "x " * 400, "x " * 300, prose(rng, 6000), "Ω≈ç√ \u00a0 ünïcödé"]
    rows = [(3 * k + 1, t, f"s{k % 4}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[2], rows[-1], (None, texts[4], "s1", 3), (None, None, None, None)]


def shingles(text):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard_classes(rows):
    """Per row: (doc_id, class_id, n_links, class_size)."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            links[i] += 1
            links[j] += 1
            root[find(j)] = find(i)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    out = []
    for k, r in enumerate(rows):
        ids = [d for d in groups[find(k)] if d is not None]
        out.append((r[0], min(ids) if ids and sets[k] else r[0], links[k], len(groups[find(k)])))
    return out


def without_repeats(rows):
    """Per row: (doc_id, n_words, n_removed, kept text)."""
    late = 1 << 63
    least, words = {}, [SPACED.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words):
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            least[key] = min(least.get(key, late), late if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if least[tuple(w[i:i + 50])] < (late if r[0] is None else r[0]):
                gone[i:i + 50] = [True] * 50
        out.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def hits(text, items):
    """(n_words, n_hit, items with hits)."""
    w = PLAIN.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        b = PLAIN.findall(lower(t))
        n = min(13, len(b))
        grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(found, key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(found, expected):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)
