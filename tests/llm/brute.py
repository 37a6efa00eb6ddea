"""Plain-Python twins that the operators are tested against."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib


def words(text):
    return (text or "").encode().lower().split()


def lower(text):
    return (text or "").encode().lower()


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard_components(rows):
    """{id: (set size, smallest id reachable)} for distinct, non-null ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def exact_groups(rows):
    """sha256 -> ids, by lower-cased text."""
    out = collections.defaultdict(list)
    for i, t in rows:
        out[hashlib.sha256(lower(t)).hexdigest()].append(i)
    return out


def base_scores(rows):
    """{id: (tokens, known, N, base score)} under add-half counts of the ids with crc32 mod 5 other than 1."""
    tokens = {i: [*words(t), b"\n"] for i, t in rows}
    counts = collections.Counter()
    for i, ts in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for i, ts in tokens.items()
    }
