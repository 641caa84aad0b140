"""Plain Python versions of the rules, for comparison on small tables."""

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def kept_lines(texts, least=10, chars=1):
    """Kept text, lines and dropped lines of each text."""
    keys = [[low(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for t in texts]
    docs = {}
    for own in keys:
        for k in set(own):
            docs[k] = docs.get(k, 0) + 1
    out = []
    for t, own in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, own, strict=True) if len(k) < chars or docs[k] < least]
        out.append(("\n".join(left), len(lines), len(lines) - len(left)))
    return out


def hits(text, items, window=13):
    """Hit positions, and the items with a window in the text, by looking at every position."""
    own, hit, found = words(text), set(), set()
    for name, body in items:
        w = words(body)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(name)
    return len(own), hit, found


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    """Smallest member reached from each of n nodes; linked(i, j) tells links."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
