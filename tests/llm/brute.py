"""Plain Python versions of the operators, over lists."""

from __future__ import annotations

import numpy as np


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width=5):
    w = words(text)
    size = min(width, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()


def reached(nodes, edges):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {n: top(n) for n in nodes}


def near_duplicates(docs, percent):
    sets = {}
    edges = []
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                edges.append((a, b))
    comp = reached(ids, edges)
    return sorted(((i, max(len(s) for s in sets[i]), comp[i], i == comp[i]) if i is not None else (None, len(shingles(t)), None, True) for i, t in docs), key=repr)


def contaminated(docs, items, threshold=0.8, width=5):
    out = []
    for item, text in items:
        if item is None or not words(text):
            continue
        own = shingles(text, width)
        size = min(width, len(words(text)))
        for i, t in docs:
            w = words(t)
            n = len(own & {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})
            if n and n >= threshold * len(own) - 1e-9:
                out.append((i, item, n, len(own), n / len(own)))
    return sorted(out, key=repr)


def near_embeddings(rows, threshold=0.98):
    able = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float) / np.abs(v).max()
            able[i] = (x / np.linalg.norm(x), label)
    ids = sorted(able)
    edges = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if able[a][1] == able[b][1] and len(able[a][0]) == len(able[b][0]) and able[a][0] @ able[b][0] >= threshold
    ]
    comp = reached({r[0] for r in rows if r[0] is not None}, edges)
    links = {}
    for a, b in edges:
        links[a] = links.get(a, 0) + 1
        links[b] = links.get(b, 0) + 1
    return sorted(((i, links.get(i, 0), comp.get(i), i == comp.get(i)) for i, _, _ in rows), key=repr)
