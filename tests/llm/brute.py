"""Plain Python answers for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, budget=4):
    """Component number of each fingerprint."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def without_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeat_words(text, window=8):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    gone = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i:i + window])] > 1:
            gone.update(range(i, i + window))
    return len(gone)


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """sizes: (source, size) in order. Reshares the excess until no source is above its cap."""
    left, open_, got = share * sum(n for _, n in sizes), list(range(len(sizes))), {}
    while open_:
        whole = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if left * weights[i % len(weights)] / whole > most * sizes[i][1]]
        if not over:
            got |= {i: left * weights[i % len(weights)] / whole for i in open_}
            break
        for i in over:
            got[i] = most * sizes[i][1]
            left -= got[i]
            open_.remove(i)
    return [got[i] for i in range(len(sizes))]
