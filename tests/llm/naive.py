"""Plain versions of the operators' results, by brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard(docs, k, num, den):
    """{id: (size, component)}"""
    sets = {i: shingle_set(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in at[s])
        for s in sets[i]:
            at[s].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def vector_links(rows, cosine):
    """{id: (links, component, kept)} of (id, vector, label)"""

    def sound(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    ids = [r[0] for r in rows]
    near = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if sound(v, a) and sound(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for q in near[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        least = min(ids[q] for q in seen)
        out[ids[i]] = (len(near[i]), least, ids[i] == least)
    return out


def tiles(item, text, least):
    """Greedy string tiling by trying every pair of places."""
    free_a, free_b, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(text)):
                n = 0
                while p + n < len(item) and q + n < len(text) and free_a[p + n] and free_b[q + n] and item[p + n] == text[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < max(1, least):
            return out
        for k in range(n):
            free_a[p + k] = free_b[q + k] = False
        out.append((p, q, n))


def segments(scores):
    """All maximal scoring segments by their definition: split off the best, then the rest on both sides."""

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = (i, j, total)
        if best is None:
            return []
        i, j, _ = best
        return split(a, i) + [best] + split(j + 1, b)

    return split(0, len(scores))
