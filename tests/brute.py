"""Slow, obvious versions of the main steps on plain lists, to compare small runs with."""

import collections
import math
import re

import numpy as np


def grams(text):
    words = re.findall(r"\b\w\w+\b", text)
    word = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    char = []
    for token in text.split():
        padded = f" {token} "
        for n in (3, 4, 5):
            if n <= len(padded):
                char += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return {"word": word, "char": char}


def blocks(texts):
    """One dict of unit-length weights per text, keys (block, term)."""
    rows = [{} for _ in texts]
    for block in ("word", "char"):
        counts = [collections.Counter(grams(t)[block]) for t in texts]
        df = collections.Counter(term for c in counts for term in c)
        for row, c in zip(rows, counts):
            w = {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
            length = math.sqrt(sum(x * x for x in w.values()))
            row.update({(block, t): x / length for t, x in w.items()})
    return rows


def dense(rows):
    terms = sorted({t for r in rows for t in r})
    place = {t: i for i, t in enumerate(terms)}
    out = np.zeros((len(rows), len(terms)))
    for i, r in enumerate(rows):
        for t, w in r.items():
            out[i, place[t]] = w
    return out


def unit(matrix):
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length < 1e-9, 1, length)


def embed(matrix, components=128):
    k = min(components, matrix.shape[0] - 1, matrix.shape[1] - 1)
    if k < 2:
        return matrix
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    return unit(u[:, :k] * s[:k])


def nearest(vectors, k):
    """{row: [(other, similarity), ...]} by similarity, then number."""
    sims = np.round(unit(vectors) @ unit(vectors).T, 9)
    out = {}
    for i in range(len(vectors)):
        others = sorted((-sims[i, j], j) for j in range(len(vectors)) if j != i)
        out[i] = [(j, -s) for s, j in others[:k]]
    return out


def edges(texts, k=15, threshold=0.3):
    rows = blocks(texts)
    matrix = dense(rows)
    lexical = unit(matrix) @ unit(matrix).T
    found = {}
    for i, near in nearest(embed(matrix), k).items():
        for j, sem in near:
            sim = 0.6 * min(max(sem, 0), 1) + 0.4 * min(max(lexical[i, j], 0), 1)
            if round(sim, 9) >= threshold:
                found[min(i, j), max(i, j)] = max(sim, found.get((min(i, j), max(i, j)), 0))
    return found


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
