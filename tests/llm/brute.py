"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[a : a + window])].add("" if item is None else str(item))
    sizes, out = {len(k) for k in windows}, []
    for doc, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if got := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def shingles(text, k=5):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in nodes}


def similar(docs, k=5):
    sets = {d: shingles(t, k) for d, t in docs}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    pairs = {(a, b) for g in by.values() for a in g for b in g if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return sorted((d, len(sets[d]), root[d]) for d in sets)


def tokens(docs, tokenizer):
    import numpy as np

    start, out = 0, []
    for doc, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
        free -= over
        if not free:
            return out
