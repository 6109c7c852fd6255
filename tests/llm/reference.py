"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import defaultdict


def shingles(text, words=5):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def jaccard(rows, words=5, percent=75):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t, words) for i, t in rows}
    by = defaultdict(list)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in by[s]:
                shared[j] += 1
            by[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed(rows, length=100):
    """doc_id -> (bytes, removed, spans, sha256 of the rest)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def components(nodes, edges):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def viterbi_tokens(word, scores, unknown):
    """Fewest tokens of the best-scored segmentation of a marked word."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + unknown * n, best[end - 1][1] + n)]
        options += [(scores[word[i:end]] + best[i][0], best[i][1] + 1) for i in range(end) if word[i:end] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]
