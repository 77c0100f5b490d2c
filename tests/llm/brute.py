"""Brute-force versions of the operators, in plain Python."""

import re

WHITE = " \t\n\x0b\x0c\r"
LOWER = {k: k + 32 for k in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_lines(rows, least=10):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    order = lambda d: (d is not None, d or 0)
    first = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= least and (k not in first or order(d) < order(first[k])):
                first[k] = d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def brute_repeats(rows, width=13):
    order = lambda d: float("inf") if d is None else d
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, float("inf")), order(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < order(d):
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def brute_components(rows, percent, width=5):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    order = lambda d: (d is not None, d or 0)
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, r in sets[i + 1 :]:
            both = len(s & r)
            if s and r and 100 * both >= percent * (len(s) + len(r) - both):
                x, y = sorted((find(a), find(b)), key=order)
                parent[y] = x
    return sorted(((d, len(s), find(d), d == find(d)) for d, s in sets), key=repr)


def brute_hits(docs, items, width=10):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if k is None else str(k))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)
