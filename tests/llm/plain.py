"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

PATTERNS = {
    "assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_spans(text):
    found = []
    for no, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                found.append((m.start(), no, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(found)]


def spans_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def lines_kept(docs, window=3):
    """docs: (id, text); texts without lines under windows that came before."""
    order = sorted(docs, key=lambda d: d[0])
    seen, out = set(), {}
    for i, text in order:
        lines = (text or "").split("\n")
        gone = set()
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p : p + window])
            if "".join(w).replace("\t", " ").replace("\r", " ").strip(" ") == "":
                continue
            if w in seen:
                gone |= set(range(p, p + window))
            seen.add(w)
        out[i] = (text if not gone else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone))
    return out


def simhash(text):
    words = [w.lower() for w in re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        counts += np.array([h >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(fps, radius=4):
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(fps))]


def pieces(tokenizer, text, capacity=1024, end=2):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids), capacity), len(ids)]
    return [(no, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for no, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_groups(rows):
    """(id, least id of the group) of each row (id, text): five-word shingle sets of likeness 0.8 or more, linked through one another."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(rows)]
