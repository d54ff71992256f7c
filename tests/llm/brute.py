"""Plain versions of the operators' definitions, for small inputs."""

import collections
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_duplicates(rows):
    """Sorted (doc_id, class_id, n_links) of (doc_id, text) pairs, over all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in holders[x] if j > i)
        for j, n in common.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8 - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, least[find(i)], links[i]) for i, (doc_id, _) in enumerate(rows))


def without_repeats(rows, length=400):
    """(doc_id, number of bytes, removed runs, kept bytes) of each (doc_id, bytes)."""
    seen = collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for doc_id, t in rows:
        covered = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                covered[p : p + length] = b"\x01" * length
        runs = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(covered))]
        out.append((doc_id, len(t), runs, bytes(b for b, c in zip(t, covered, strict=True) if not c)))
    return out
