"""Plain statements of what the operators must return, for small inputs."""

import re
from collections import defaultdict

import numpy as np

BLANK = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    ws = WORD.findall(lower(text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1)))


def near_duplicates(docs, width=5, percent=80):
    """docs: (id, text), ids distinct -> {id: (n_shingles, component, kept)}."""
    sets = {i: shingles(t, width) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def drop_lines(docs, min_length=20, min_docs=3):
    """docs: (id, text) -> [(id, n_lines, n_dropped, kept text)] in the order given; a null id counts as the least."""
    rank = lambda i: -(10**30) if i is None else i
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = lower(line.strip(BLANK))
            if len(key) >= min_length:
                holders[key].add(rank(i))
    gone = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if gone.get(lower(x.strip(BLANK)), rank(i)) == rank(i)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def near_vectors(rows, cosine=0.93):
    """rows: (id, label, vector), ids distinct -> {id: (n_links, component)}."""
    def usable(v):
        return v and None not in v and all(np.isfinite(v)) and any(v)

    good = [(i, k, np.array(v, float)) for i, k, v in rows if k is not None and usable(v)]
    links = [
        (a[0], b[0]) for a in good for b in good
        if a[0] < b[0] and a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.sqrt((a[2] @ a[2]) * (b[2] @ b[2])) >= cosine
    ]
    comp = components([r[0] for r in rows], links)
    return {i: (sum(i in p for p in links), comp[i]) for i, _, _ in rows}
