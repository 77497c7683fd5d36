"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import substrings
from termloom.llm.queries import op13_substring_dedup
from termloom.operators import skew

from . import cases


def words_of(text):
    return (text or "").encode().split()


def rank(doc_id):
    return substrings.LARGEST if doc_id is None else doc_id


def slow(rows, window=50):
    least = {}
    for r in rows:
        words = words_of(r["text"])
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            least[w] = min(rank(r["doc_id"]), least.get(w, substrings.LARGEST))
    found = Counter()
    for r in rows:
        words = words_of(r["text"])
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < rank(r["doc_id"]):
                gone[i : i + window] = True
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        found[r["doc_id"], len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()] += 1
    return found


def small(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, minimiser int, gone string")


def judged(docs, **options):
    rows = substrings.dedup_substrings(docs, **options).collect()
    return Counter(
        (r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows
    )


def test_query_matches_a_dictionary_of_windows(spark, tmp_path):
    docs = cases.given(spark)
    rows = docs.collect()
    longest = max(rows, key=lambda r: len(r["text"] or ""))["text"]
    half = longest[: len(longest) // 2]
    more = [(900_100, half), (900_100, half), (None, longest), (-7, longest[100:3_000]), (900_101, "new " + longest + " end")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(map(tuple, op13_substring_dedup(spark, str(tmp_path)).collect()))
    assert found == slow(docs.collect())
    assert sum(n for (_, _, gone, _), n in found.items() if gone) > 10


@pytest.mark.parametrize("heavy_parts", [8, 10_000])
def test_passages_ties_and_hot_groups(spark, monkeypatch, heavy_parts):
    """Copies, passages in many contexts, windows that repeat inside a document; with and without heavy buckets."""
    monkeypatch.setattr(substrings, "HEAVY_PARTS", heavy_parts)
    monkeypatch.setattr(skew, "LEAST_HOT", 20)
    rng = random.Random(heavy_parts)
    draw = lambda n, k=400: [f"w{rng.randrange(k)}" for _ in range(n)]
    passage, line, page = draw(30), draw(9), draw(120)
    rows = []
    for i in range(150):
        words = draw(rng.randint(0, 30)) + passage[: rng.choice([12, 25, 30])] + draw(rng.randint(0, 20))
        if i % 3 == 0:
            words += line * 3 + draw(5)
        if i % 4 == 0:
            words = page[i % 7 :] + words
        if i % 10 == 0:
            words = page
        rows.append((rng.choice([i, i, 5, None]), rng.choice([" ", "\n "]).join(words), 1, "x"))
    rows += rows[:5] + [(1, "ab " * 60, 1, "x"), (2, "ab " * 60, 1, "x"), (3, None, 1, "x"), (4, "", 1, "x")]
    docs = small(spark, rows).repartition(5)
    assert judged(docs, window=12, seed_words=3) == slow(docs.collect(), 12)


def test_no_rows(spark):
    assert substrings.dedup_substrings(cases.none(spark)).collect() == []


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that is the same everywhere, comparing words alone finds the classes."""
    monkeypatch.setattr(substrings, "rolling", lambda v, n: np.zeros(max(0, len(v) - n + 1), np.uint64))
    texts = [b"a b c d e", b"x b c d e", b"a b c d e", b"c d e"]
    row, first, count = substrings.repeated_windows(pa.array(texts), np.array([1, 2, 3, 4]), 3)
    assert list(zip(row.tolist(), first.tolist(), count.tolist(), strict=True)) == [(1, 1, 2), (2, 0, 3), (3, 0, 1)]


@pytest.mark.parametrize("size", [1, 2, 3, 8, 13])
def test_rolling_and_minimum(size):
    values = np.random.default_rng(size).integers(0, 1 << 64, 40, np.uint64)
    low = [values[i : i + size].min() for i in range(41 - size)]
    assert substrings.window_minimum(values, size).tolist() == low
    want = []
    for i in range(41 - size):
        h = 0
        for v in values[i : i + size].tolist():
            h = (h * substrings.FACTOR + v) % (1 << 64)
        want.append(h)
    assert substrings.rolling(values, size).tolist() == want
