"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import runs
from termloom.llm.queries import op12_periodic_runs

from . import cases


def slow_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(6, 4 * q):
                part = words[start : start + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def judge(texts):
    got, collapsed = runs._judge(pa.array([t.encode() for t in texts], pa.binary()))
    return [([(r["start"], r["length"], r["period"]) for r in x], c.decode())
            for x, c in zip(got.to_pylist(), collapsed.to_pylist(), strict=True)]


@pytest.mark.parametrize("seed", range(8))
def test_random_texts_with_planted_periods(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 8)):
            n, letters = rng.choice([0, 1, 5, 6, 7, 20, 50, 120, 300]), rng.choice([1, 2, 3, 10, 1000])
            words = [f"w{rng.randrange(letters)}" for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            texts.append(" ".join(words))
        for text, got in zip(texts, judge(texts), strict=True):
            want = slow_runs(text.split())
            assert got == (want, collapse(text.split(), want))


def test_fibonacci_words_and_nested_runs():
    a, b = "a", "ab"
    while len(b) < 3_000:
        a, b = b, b + a
    nested = (["x"] * 6 + ["y"]) * 5 + ["z"]
    for words in (list(b), nested * 4, nested * 4 + ["x"] * 7):
        want = slow_runs(words)
        assert judge([" ".join(words)]) == [(want, collapse(words, want))]


@pytest.mark.parametrize("period", [1, 3, 63, 64, 65, 4_096, 50_001])
def test_long_periods(period):
    words = [f"p{i % period}" for i in range(210_000)]
    assert judge([" ".join(["start", *words, "end"])])[0][0] == [(1, 210_000, period)]


def test_blocks_longer_than_the_transform(monkeypatch):
    monkeypatch.setattr(runs, "LONGEST", 4)
    rng = random.Random(5)
    for p in (5, 9, 16, 31):
        base = [f"w{rng.randrange(3)}" for _ in range(p)]
        words = [f"l{i}" for i in range(7)] + base * 6 + ["end"] + ["a"] * 40 + base
        want = slow_runs(words)
        assert judge([" ".join(words)]) == [(want, collapse(words, want))]


@pytest.mark.parametrize("size", [1, 2, 32, 64, 128, 4_096])
def test_transform_is_exact(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-(runs.PRIME // 2), runs.PRIME // 2, (3, size)).astype(np.float64)
    back = runs.inverse(runs.transform(x))
    assert ((back - x * size) % runs.PRIME == 0).all()


def test_chance_zeros_are_found_out():
    """Codes that differ by the prime look equal to the transform."""
    codes = np.array([0, runs.PRIME] * 20 + [-1])
    assert runs.find_runs(codes, np.array([40])).tolist() == [[0, 40, 2]]


def plant(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_query_on_whole_documents(spark, tmp_path):
    docs = cases.given(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = Counter(), 0
    for r in docs.collect():
        if r["doc_id"] == 900_013:
            found, words = [(0, 30_000, 1)], ["word"] * 30_000
        else:
            before = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
            words = plant(r["doc_id"], before)
            planted += words != before
            found = slow_runs(words)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[(r["doc_id"], len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
              hashlib.sha256(lines.encode()).hexdigest(),
              hashlib.sha256(collapse(words, found).encode()).hexdigest())] += 1
    assert planted > 10
    assert Counter(map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect())) == want


def test_no_rows(spark):
    assert runs.periodic_runs(cases.none(spark)).collect() == []
