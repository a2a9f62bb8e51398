"""Array kernels run inside Spark tasks on one bounded block of a volume."""

from __future__ import annotations

import numpy as np

#: Squared distance of a line position that has seen no background yet.
FAR = np.int64(1) << 40


def gaussian_taps(sigma: float) -> np.ndarray:
    """Half kernel ``w[0..radius]`` of a normalised Gaussian cut at four sigma."""
    radius = int(4.0 * sigma + 0.5)
    k = np.arange(radius + 1, dtype=np.float64)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    return w / (w[0] + 2.0 * w[1:].sum())


def smooth_columns(block: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Symmetric filter down axis 0, edges mirrored, rounded to float32."""
    n, r = len(block), len(taps) - 1
    padded = np.pad(block.astype(np.float64), ((r, r), (0, 0)), mode="symmetric")
    total = padded[r : r + n] * taps[0]
    for k in range(1, r + 1):
        total += (padded[r - k : r - k + n] + padded[r + k : r + k + n]) * taps[k]
    return total.astype(np.float32)


#: Offsets that are tried one by one; columns with farther background build an envelope.
NEAR = 24


def lower_envelope(block: np.ndarray) -> np.ndarray:
    """``min over j of block[j] + (i - j)^2`` down axis 0 (squared distances).

    Columns without background stay ``FAR`` and take no part in the search.  Where all
    minima lie within ``NEAR`` steps a few shifts of the block find them; the other
    columns take a pass that is linear in their length.
    """
    out = np.full_like(block, FAR)
    live = np.flatnonzero((block < FAR).any(axis=0))
    block = block[:, live]
    best = block.copy()
    for k in range(1, min(len(block), NEAR + 1)):
        if k * k >= best.max(initial=0):
            break
        np.minimum(best[k:], block[:-k] + k * k, out=best[k:])
        np.minimum(best[:-k], block[k:] + k * k, out=best[:-k])
    far = np.flatnonzero(best.max(axis=0, initial=0) > (NEAR + 1) ** 2)
    if len(far) and len(block) > NEAR + 1:
        best[:, far] = parabolas(block[:, far])[0]
    out[:, live] = np.minimum(best, FAR)
    return out


def parabolas(block: np.ndarray) -> tuple[np.ndarray, int]:
    """The same by the lower envelope of the parabolas of each column, and the comparisons made.

    Positions are added one after the other, in all columns at once.  Each column keeps a
    stack of the parabolas in its envelope and the first position where each is the least;
    one that the new parabola undercuts from its start on is taken off, once.  So a column
    makes at most two comparisons a position.
    """
    n, columns = block.shape
    every = np.arange(columns)
    owner = np.zeros((n, columns), np.int64)
    start = np.zeros((n, columns), np.int64)
    top = np.full(columns, -1)
    compared = 0
    for q in range(n):
        todo = every[block[q] < FAR]
        value = block[q] + q * q
        while len(todo):
            filled = top[todo] >= 0
            first = todo[~filled]
            top[first] = 0
            owner[0, first], start[0, first] = q, 0
            todo = todo[filled]
            compared += len(todo)
            below = owner[top[todo], todo]
            # From the first whole position behind the crossing on, q is the lower one.
            cross = (value[todo] - block[below, todo] - below * below) // (2 * (q - below)) + 1
            gone = cross <= start[top[todo], todo]
            stay, cross = todo[~gone], cross[~gone]
            seen = cross < n
            stay, cross = stay[seen], cross[seen]
            top[stay] += 1
            owner[top[stay], stay], start[top[stay], stay] = q, cross
            todo = todo[gone]
            top[todo] -= 1
    out = np.full_like(block, FAR)
    rows = np.arange(n)
    for c in every[top >= 0]:
        k = int(top[c]) + 1
        own = np.repeat(owner[:k, c], np.diff(np.append(start[:k, c], n)))
        out[:, c] = block[own, c] + (rows - own) ** 2
    return out, compared


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes under edges a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ``(row, value)`` with ``first[row] <= value < last[row]``."""
    size = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(size)), size)
    start = np.repeat(first - (np.cumsum(size) - size), size)
    return row, np.arange(len(row)) + start


def ascending(keys: list[np.ndarray]) -> bool:
    """Whether rows stand in strictly ascending order of four whole-number keys."""
    step = [np.diff(k.astype(np.int64)) for k in keys]
    return bool((np.select([step[0] != 0, step[1] != 0, step[2] != 0], step[:3], step[3]) > 0).all())


def touching(keys: list[np.ndarray], x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """First of each chain of runs, sorted by ``keys`` and ``x0``, in which every run begins where the one before ends."""
    opens = np.ones(len(x0), bool)
    opens[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0) | (x0[1:].astype(np.int64) != x1[:-1].astype(np.int64) + 1)
    return np.flatnonzero(opens)
