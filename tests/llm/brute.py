"""Plain versions of what the corpus operators compute."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def targets(sizes: dict, most=3.0):
    """sizes: words by source."""
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped and sizes[s] > 0]
        level = (left - sum(capped.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, w[s] * level if sizes[s] else 0.0) for s in order}
        capped |= {s: most * sizes[s] for s in over}


def simhash(t, size=3):
    w = words(lower(t))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, fps, distance=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def repeat_words(t):
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})


def dup_lines(t):
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(lines) - len(set(lines))


def canonical(t):
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", nfkc(nfkc(t or "").casefold())).strip()


def repeated_bytes(texts, length=200):
    """removed count, spans, sha256 of the rest for each text."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def unigram(rows):
    """rows: (id, text). Per row: held_out, n_tokens, n_known, train_tokens, base_score."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    toks = [words(lower(t)) + [None] for _, t in rows]
    c = Counter(x for h, w in zip(held, toks, strict=True) if not h for x in w)
    total, types = sum(c.values()), len(c)
    return [(h, len(w), sum(x in c for x in w), total, sum(math.log10((c[x] + 1) / (total + types + 1)) for x in w)) for h, w in zip(held, toks, strict=True)]
