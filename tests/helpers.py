"""Plain NumPy references for small volumes."""

import heapq
from itertools import permutations, product

import numpy as np
from pyspark.sql import functions as F


def rows_of(volumes, name="value", keep_zero=False):
    """Voxel rows of ``{vol_id: array}``."""
    out = []
    for vol, arr in volumes.items():
        for (z, y, x), v in np.ndenumerate(arr):
            if keep_zero or v:
                out.append((vol, int(z), int(y), int(x), int(v)))
    return out


def voxel_table(spark, volumes, name="value", keep_zero=False):
    return spark.createDataFrame(rows_of(volumes, name, keep_zero), f"vol_id int, z int, y int, x int, {name} int")


def catalog(spark, volumes):
    rows = [(v, *map(int, a.shape)) for v, a in volumes.items()]
    return spark.createDataFrame(rows, "vol_id int, depth int, height int, width int")


def to_arrays(voxels, volumes, name):
    out = {v: np.zeros(a.shape, np.int64) for v, a in volumes.items()}
    for r in voxels.collect():
        assert out[r.vol_id][r.z, r.y, r.x] == 0, "voxel listed twice"
        out[r.vol_id][r.z, r.y, r.x] = r[name]
    return out


def mask_arrays(runs, volumes):
    from voxmill.functions import runs as R

    return to_arrays(R.to_voxels(runs).withColumn("one", F.lit(1)), volumes, "one")


def steps(k):
    return [s for s in product((-1, 0, 1), repeat=3) if 1 <= sum(map(abs, s)) <= k]


def components(mask, k=1):
    lab = np.zeros(mask.shape, np.int64)
    n = 0
    for start in zip(*np.nonzero(mask)):
        if lab[start]:
            continue
        n += 1
        lab[start] = n
        stack = [start]
        while stack:
            p = stack.pop()
            for s in steps(k):
                q = tuple(a + b for a, b in zip(p, s))
                if all(0 <= a < m for a, m in zip(q, mask.shape)) and mask[q] and not lab[q]:
                    lab[q] = n
                    stack.append(q)
    return lab


def ball(r):
    return [o for o in product(range(-r, r + 1), repeat=3) if sum(a * a for a in o) <= r * r]


def dilate(mask, r):
    out = np.zeros_like(mask, bool)
    for p in zip(*np.nonzero(mask)):
        for o in ball(r):
            q = tuple(a + b for a, b in zip(p, o))
            if all(0 <= a < m for a, m in zip(q, mask.shape)):
                out[q] = True
    return out


def erode(mask, r):
    out = np.zeros_like(mask, bool)
    for p in np.ndindex(mask.shape):
        near = [tuple(a + b for a, b in zip(p, o)) for o in ball(r)]
        out[p] = all(all(0 <= a < m for a, m in zip(q, mask.shape)) and mask[q] for q in near)
    return out


def distance(mask):
    bg = np.argwhere(~mask)
    out = np.zeros(mask.shape, np.int64)
    for p in zip(*np.nonzero(mask)):
        out[p] = ((bg - np.array(p)) ** 2).sum(1).min()
    return out


def spanning_flood(d2, markers):
    """Kruskal on the 6-neighbour graph with the total edge order of the flooding."""
    pos = {p: (p[0] << 42) | (p[1] << 21) | p[2] for p in zip(*map(lambda a: a.tolist(), np.nonzero(d2)))}
    edges = []
    for p in pos:
        for s in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
            q = tuple(a + b for a, b in zip(p, s))
            if q in pos:
                a, b = -int(d2[p]), -int(d2[q])
                edges.append((max(a, b), min(a, b), pos[p], pos[q], p, q))
    parent = {p: p for p in pos}
    label = {p: int(markers[p]) for p in pos}

    def find(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    for *_, p, q in sorted(edges):
        a, b = find(p), find(q)
        if a != b and not (label[a] and label[b]):
            parent[a] = b
            label[b] = label[a] or label[b]
    out = np.zeros(d2.shape, np.int64)
    for p in pos:
        out[p] = label[find(p)]
    return out


def queue_flood(d2, markers):
    """Priority-queue flooding, first come first served on equal levels."""
    out = np.where(d2 > 0, markers, 0)
    heap, age = [], 0
    for p in zip(*map(lambda a: a.tolist(), np.nonzero(out))):
        heapq.heappush(heap, (-int(d2[p]), age, p))
        age += 1
    while heap:
        _, _, p = heapq.heappop(heap)
        for s in steps(1):
            q = tuple(a + b for a, b in zip(p, s))
            if all(0 <= a < m for a, m in zip(q, d2.shape)) and d2[q] and not out[q]:
                out[q] = out[p]
                heapq.heappush(heap, (-int(d2[q]), age, q))
                age += 1
    return out


def greedy(points, min_dist):
    """Kept indices of points already in priority order."""
    kept = []
    for i, p in enumerate(points):
        if all(sum((a - b) ** 2 for a, b in zip(p, points[j])) >= min_dist**2 for j in kept):
            kept.append(i)
    return kept


def best_total(gain):
    """Largest total of a one-to-one choice, by trying all of them."""
    gain = np.asarray(gain)
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    n, m = gain.shape
    return max(sum(gain[i, c] for i, c in enumerate(cols)) for cols in permutations(range(m), n))
