"""Plain versions of the training-data operators, for small tables."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(A_Z) if lower else text or "")


def windows_removed(docs, length=13):
    """doc_id: (number of words, kept words)."""
    split = {k: words(t) for k, t in docs}
    first = {}
    for k in sorted(split):
        for i in range(len(split[k]) - length + 1):
            first.setdefault(tuple(split[k][i : i + length]), k)
    out = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < k for j in range(i, i + length)}
        out[k] = (len(w), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def shingles(text, size=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(docs, percent=75, size=5):
    """doc_id: (set size, smallest id reachable)."""
    sets = {k: shingles(t, size) for k, t in docs}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k in sorted(sets):
        common = Counter(o for s in sets[k] for o in holders[s])
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[o]) - n):
                a, b = sorted((find(k), find(o)))
                parent[b] = a
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def lines_kept(docs, min_chars=20, min_docs=3):
    """doc_id: (lines, dropped, kept text)."""
    space = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for k, t in docs:
        for line in (t or "").split("\n"):
            holders[line.strip(space).translate(A_Z)].add(k)
    out = {}
    for k, t in docs:
        all_lines = (t or "").split("\n")
        keys = [x.strip(space).translate(A_Z) for x in all_lines]
        kept = [x for x, key in zip(all_lines, keys) if not (len(key) >= min_chars and len(holders[key]) >= min_docs and max(holders[key]) != k)]
        out[k] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())
