"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def removed_bytes(rows, length):
    """(id, n_bytes, n_removed, n_spans, sha256 of what is left) by counting every window."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def shingle_counts(text, width=5):
    w = words(text)
    return Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)] if w else [])


def probability_jaccard(v, w):
    keys = v.keys() | w.keys()
    return sum(1 / sum(max(v[j] / v[i], w[j] / w[i]) for j in keys) for i in v.keys() & w.keys())


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {i: root(i) for i in up}


def near_duplicates(rows, similarity=0.8):
    rows = [(i, t or "") for i, t in rows if i is not None]
    sets = [(i, t, shingle_counts(t)) for i, t in rows]
    links = [(a[0], b[0]) for k, a in enumerate(sets) for b in sets[:k] if a[1] == b[1] or (a[2] and b[2] and probability_jaccard(a[2], b[2]) >= similarity - 1e-12)]
    return components([i for i, _ in rows], links)


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def base_scores(rows, n=5, rest=1):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(i, [*words((t or "").translate(lower)), None]) for i, t in rows]
    count = Counter(w for i, ws in tokens if fold(i, n) != rest for w in ws)
    total, distinct = sum(count.values()), len(count)
    return [(i, fold(i, n) == rest, len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)) for i, ws in tokens]
