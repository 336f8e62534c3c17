"""Plain, slow versions of the operators, to hold the real ones against."""

import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeats(docs, span=50):
    """(id, bytes, removed, spans, digest of the rest) of each document."""
    texts = sorted((d, (t or "").encode()) for d, t in docs)
    first, out = {}, []
    for d, b in texts:
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], d)
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text, size):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near(docs, size=4, percent=80):
    """(id, shingles, component, kept) of each document."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for d, s in sorted(sets.items()):
        counts = {}
        for v in s:
            for other in lists.setdefault(v, []):
                counts[other] = counts.get(other, 0) + 1
            lists[v].append(d)
        for other, both in counts.items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                x, y = find(d), find(other)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def overlaps(docs, items, length=10):
    """(id, words, hit words, items, digest of the items, contaminated) of each document."""
    windows = {}
    for item, text in items:
        w = BENCH_WORD.findall(lower(text))
        n = min(length, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes, out = sorted({len(x) for x in windows}), []
    for d, text in docs:
        w, hit, who = BENCH_WORD.findall(lower(text)), set(), set()
        for n, i in itertools.chain.from_iterable(((n, i) for i in range(len(w) - n + 1)) for n in sizes):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                who |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out)
